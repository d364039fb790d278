"""Quality rules: a threshold table compiled into one native projection."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesignal.llm.common import apart, together

#: Common words of the languages in question.
STOP_WORDS = (
    "the be to of and that have with in is it for on as are this was by from an a "
    "der die das und ist nicht ein eine zu den von mit sich des im für auf dem "
    "le la les de des et un une est que qui dans pour en du sur pas "
    "el los las que y en un una por con para no es se del al"
).split()


class Rule(NamedTuple):
    """A document fails if the value is below ``least`` or above ``most``."""

    name: str
    value: str
    least: float | None = None
    most: float | None = None


#: ``value`` is SQL over the columns of ``measures``.
RULES = (
    Rule("words", "n_words", least=50),
    Rule("repeated_words", "n_repeat_words / nullif(n_words, 0)", most=0.5),
    Rule("word_length", "word_chars / nullif(n_words, 0)", least=2, most=15),
    Rule("symbols", "n_symbols / nullif(n_words, 0)", most=0.1),
    Rule("stop_words", "n_stop_words", least=2),
    Rule("repeated_lines", "n_dup_lines / nullif(n_lines, 0)", most=0.6),
    Rule("list_lines", "n_list_lines / nullif(n_lines, 0)", most=0.9),
    Rule("open_lines", "n_open_lines / nullif(n_lines, 0)", most=0.3),
    Rule("capitals", "n_capitals / nullif(word_chars, 0)", most=0.5),
)
#: The columns that ``judge`` adds.
RESULTS = (
    *("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words", "n_list_lines", "n_open_lines"),
    *("n_capitals", "n_repeat_words", "failed_rules", "base_failed", "kept"),
)
#: The rules whose failing is reported as base_failed.
BASE = ("words", "repeated_words")

SPACE = "[\\\\x20\\\\x09-\\\\x0D]"


def measures() -> list[tuple[str, str]]:
    """Named SQL expressions in the order in which they build on each other, from ``text`` on."""
    words = "', '".join(STOP_WORDS)
    return [
        ("_t", "coalesce(text, '')"),
        ("_b", "btrim(_t, ' \\t\\n\\u000B\\u000C\\r')"),
        ("_w", f"if(_b = '', cast(array() as array<string>), split(_b, '{SPACE}+', -1))"),
        ("_l", "filter(split(_t, '\\n', -1), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')"),
        ("n_words", "cast(size(_w) as bigint)"),
        ("word_chars", "cast(length(array_join(_w, '')) as bigint)"),
        ("n_symbols", "cast(regexp_count(_t, '[#*$%&|<>]') as bigint)"),
        ("n_lines", "cast(size(_l) as bigint)"),
        ("n_dup_lines", "cast(size(_l) - size(array_distinct(_l)) as bigint)"),
        ("n_stop_words", f"cast(size(filter(_w, w -> w in ('{words}'))) as bigint)"),
        ("n_list_lines", "cast(size(filter(_l, l -> l rlike '^\\\\s*[-*•]')) as bigint)"),
        ("n_open_lines", "cast(size(filter(_l, l -> l rlike '(…|[.]{3})\\\\s*$')) as bigint)"),
        ("n_capitals", "cast(regexp_count(_t, '\\\\p{Lu}') as bigint)"),
        ("_h", "transform(_w, w -> xxhash64(w))"),
        (
            "_g",
            "if(size(_h) < 3, cast(array() as array<bigint>), transform(sequence(0, size(_h) - 3),"
            " i -> xxhash64(_h[i], _h[i + 1], _h[i + 2])))",
        ),
        # Where a three-word window occurs twice: all with their places, sorted, so that equal ones are neighbours.
        (
            "_s",
            "if(size(array_distinct(_g)) = size(_g), cast(array() as array<struct<h: bigint, i: int>>),"
            " sort_array(transform(_g, (h, i) -> struct(h, i))))",
        ),
        (
            "_p",
            "sort_array(transform(filter(_s, (x, k) -> x.h <=> get(_s, k - 1).h or x.h <=> get(_s, k + 1).h), x -> x.i))",
        ),
        (
            "n_repeat_words",
            "cast(aggregate(_p, named_struct('n', 0, 'end', 0), (s, i) ->"
            " named_struct('n', s.n + i + 3 - greatest(s.end, i), 'end', i + 3), s -> s.n) as bigint)",
        ),
    ]


def verdict(rule: Rule) -> str:
    """SQL that is true where a document fails the rule; a ratio over nothing does not fail."""
    sides = [f"{rule.value} < {rule.least}D"] if rule.least is not None else []
    sides += [f"{rule.value} > {rule.most}D"] if rule.most is not None else []
    return f"coalesce({' or '.join(sides)}, false)"


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All columns, the measures, base_failed, failed_rules and kept.

    One projection of built-in functions, without a shuffle. Words are runs of
    other signs than the six ASCII white space characters. A null text has no
    words and fails; a null id, repeated rows and further columns pass
    through; columns named like a result are replaced, others keep their values whatever
    their names. An empty table gives an empty one.
    """
    out, rest = apart(docs, ("doc_id", "text"))
    for name, sql in measures():
        out = out.withColumn(name, F.expr(sql))
    failed = [F.when(F.expr(verdict(r)), F.lit(r.name)) for r in rules]
    base = [F.expr(verdict(r)) for r in rules if r.name in BASE]
    out = out.withColumn("failed_rules", F.array_compact(F.array(*failed)))
    either = base[0] if base else F.lit(False)
    for b in base[1:]:
        either = either | b
    # Spark moves no filter past an expression that depends on the partition; it
    # would copy these measures into the filter once for every use.
    kept = F.when(F.spark_partition_id() >= 0, F.size("failed_rules") == 0)
    out = out.withColumns({"base_failed": either, "kept": kept})
    return together(out, docs, rest, RESULTS)
