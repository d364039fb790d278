"""Column expressions used by the operators."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitesignal.schema import (
    BASES,
    DRACH_MOTIFS,
    DRACH_PATTERN,
    SEQUENCE_LENGTH,
)

# The texts a data-frame CSV reader takes as missing.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]


def _column(c):
    return F.col(c) if isinstance(c, str) else c


def is_blank(c) -> Column:
    """True if the text holds nothing but (Unicode) white space."""
    return ~_column(c).rlike(r"(?U)\S")


def is_missing_token(c) -> Column:
    """True if a CSV field counts as missing."""
    return _column(c).isNull() | _column(c).isin(MISSING_TOKENS)


def present(c) -> Column:
    """The value, with NaN turned into null so that aggregates skip it."""
    return F.nanvl(_column(c).cast("double"), F.lit(None).cast("double"))


def strict_double(c) -> Column:
    """Text or number as a double; text that is no number fails the query, whatever ANSI mode says."""
    column = _column(c)
    number = column.try_cast("double")
    failed = F.raise_error(F.concat(F.lit("not a number: "), column.cast("string"))).cast("double")
    return F.when(column.isNotNull() & number.isNull(), failed).otherwise(number)


def central_kmer(sequence="sequence") -> Column:
    """The central 5-mer of a 7-mer."""
    return F.substring(_column(sequence), 2, 5)


def is_drach(motif) -> Column:
    """True for one of the 18 DRACH motifs, false otherwise and for null."""
    return F.coalesce(_column(motif).rlike(DRACH_PATTERN), F.lit(False))


def log_dwell(c) -> Column:
    """Natural log of a dwell time.

    Zero gives minus infinity and a negative value counts as missing, where
    Spark's ``ln`` alone would give null for both.
    """
    x = _column(c)
    return F.when(x > 0, F.ln(x)).when(x == 0, F.lit(float("-inf")))


def sequence_one_hot(sequence="sequence") -> list[Column]:
    """28 byte columns ``seq_pos{0-6}_{A,C,G,T}``."""
    s = _column(sequence)
    return [
        (F.substring(s, p + 1, 1) == b).cast("byte").alias(f"seq_pos{p}_{b}")
        for p in range(SEQUENCE_LENGTH)
        for b in BASES
    ]


def motif_one_hot(motif) -> list[Column]:
    """19 byte columns: one per DRACH motif, then ``motif_other``."""
    m = _column(motif)
    known = [(m == d).cast("byte").alias(f"motif_{d}") for d in DRACH_MOTIFS]
    return [*known, (~m.isin(DRACH_MOTIFS)).cast("byte").alias("motif_other")]


def label_group(label="label") -> Column:
    """A 0/1 label as the text "0" or "1"."""
    return _column(label).cast("int").cast("string")


def percent(part, whole) -> Column:
    """100 * part / whole; null if the whole is zero."""
    return F.try_divide(
        F.lit(100.0) * _column(part).cast("double"), _column(whole).cast("double")
    )
