"""Small file operations on whatever file system a path belongs to."""


class Storage:
    """Paths are resolved by Hadoop, so local, HDFS and object stores work."""

    def __init__(self, spark):
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _open(self, path):
        target = self._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self._conf), target

    def exists(self, path):
        files, target = self._open(path)
        return files.exists(target)

    def delete(self, path):
        files, target = self._open(path)
        files.delete(target, True)

    def rename(self, source, path):
        """Give a file or folder another name, which must be free; one step on file systems."""
        files, target = self._open(path)
        if files.exists(target) or not files.rename(self._open(source)[1], target):
            raise FileExistsError(f"{source} could not be renamed to {path}.")

    def names(self, folder):
        files, target = self._open(folder)
        return [s.getPath().getName() for s in files.listStatus(target)] if files.exists(target) else []

    def read_text(self, path):
        files, target = self._open(path)
        stream = files.open(target)
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def write_text(self, path, text):
        files, target = self._open(path)
        stream = files.create(target, False)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
