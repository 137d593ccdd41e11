"""License scans: ordered signature rules over words, in DataFrame functions only.

Each text becomes its words, A-Z lower-cased, with one space between and around
them, so rules are regular expressions over words.  A rule has keywords, one of
which all its matches hold; the words of a text are met with all rules' keywords
at once, and a rule is tried only where a keyword of its own is there.  A
detection within another of higher priority, or of the same and longer, is
suppressed.  The rules are in signatures.py.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .signatures import SIGNATURES
from .urls import LOWER, UPPER

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases that count in the base figures, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: The confidence of a base phrase.
BASE_SURE = 0.5


#: Versions that a signature of Creative Commons stands for, a rule each; where it is optional, there is one without as well.
VERSIONS, _ANY, _OPTIONAL = ("1 0", "2 0", "2 5", "3 0", "4 0"), "[1-4] [05]", "(?: [1-4] [05])?"


@cache
def rules() -> tuple[tuple[str, tuple[str, ...], int, float, str], ...]:
    """(label, keywords, priority, confidence, pattern) of every rule, in order."""
    found = []
    for line in SIGNATURES.strip().split("\n"):
        label, keys, priority, sure, pattern = line.split("; ")
        made = [(label, pattern.replace(_OPTIONAL, ""))] if _ANY not in pattern or _OPTIONAL in pattern else []
        if _ANY in pattern:
            made += [(f"{label}-{v.replace(' ', '.')}", pattern.replace(_OPTIONAL, f" {v}").replace(_ANY, v)) for v in VERSIONS]
        found += [(name, tuple(keys.split(",")), int(priority), float(sure), text) for name, text in made]
    return tuple(found)


def _words(text: Column) -> Column:
    plain = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(plain, SEPARATORS, " ")), F.lit(" "))


def _spaces(of: str) -> str:
    return f"(length({of}) - length(replace({of}, ' ', '')))"


_KIND = "array<struct<first: int, last: int, priority: int, label: string, sure: double>>"
# all matches of a rule and the pieces between them, in one pass; c: spaces before a match; words from 0
_FOUND = f"""
flatten(transform(filter(rules, r -> arrays_overlap(_k, r.keys)),
  r -> transform(array(struct(regexp_extract_all(_t, r.pattern, 0) AS m, split(_t, r.pattern, -1) AS p)), x ->
    if(size(x.m) = 0, cast(array() AS {_KIND}), aggregate(sequence(0, size(x.m) - 1),
      struct({_spaces("x.p[0]")} AS c, cast(array() AS {_KIND}) AS got),
      (a, i) -> struct(
        a.c + {_spaces("x.m[i]")} + {_spaces("x.p[i + 1]")} AS c,
        concat(a.got, array(named_struct('first', a.c - 1, 'last', a.c - 1 + {_spaces("x.m[i]")}, 'priority', r.priority, 'label', r.label, 'sure', r.sure))) AS got)).got))[0]))"""
# in the order of their starts, the longer first, the higher priority first: whatever holds a detection comes before it.
# ends: the furthest end so far by priority, from 0 to 9; before: the detection before and whether it stayed
_KEPT = f"""
aggregate(
  array_sort(_found, (x, y) -> CASE WHEN x.first <> y.first THEN x.first - y.first WHEN x.last <> y.last THEN y.last - x.last WHEN x.priority <> y.priority THEN y.priority - x.priority
    WHEN x.label < y.label THEN -1 WHEN x.label > y.label THEN 1 WHEN x.sure > y.sure THEN -1 WHEN x.sure < y.sure THEN 1 ELSE 0 END),
  struct(array_repeat(-1, 10) AS ends, struct(-1 AS first, -1 AS last, -1 AS priority, false AS stays) AS before, cast(array() AS {_KIND}) AS got),
  (a, d) -> transform(array(if(a.before.first = d.first AND a.before.last = d.last AND a.before.priority = d.priority, a.before.stays, NOT exists(slice(a.ends, d.priority + 1, 10 - d.priority), e -> e >= d.last))), s -> struct(
    transform(a.ends, (e, i) -> if(i = d.priority, greatest(e, d.last), e)) AS ends,
    struct(d.first AS first, d.last AS last, d.priority AS priority, s AS stays) AS before,
    if(s, concat(a.got, array(d)), a.got) AS got))[0]).got"""


def _starts(phrase: str) -> str:
    at = " AND ".join(f"get(w, i{f' + {k}' if k else ''}) = '{word}'" for k, word in enumerate(phrase.split()))
    return f"if(contains(_t, ' {phrase} '), transform(array(split(trim(_t), ' ')), w -> filter(sequence(0, size(w) - 1), i -> {at}))[0], cast(array() AS array<int>))"


def scans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, base (places of the base phrases), base_labels, detections and labels as arrays, and score.

    A detection has its first and last word, priority, label and confidence;
    those suppressed are gone, and of equal ones all stay.  score: the highest
    confidence among detections and base phrases (which have theirs), 0 without
    any.  A null text is empty and an empty one has no words.  Columns of docs by
    the six names are replaced; all others come through whatever their names.
    """
    tick = lambda c: "`" + c.replace("`", "``") + "`"
    new = ["n_words", "base", "base_labels", "detections", "labels", "score"]
    row = [F.col(tick(c)) for c in docs.columns if c not in new]
    literal = "array({})".format(", ".join(f"named_struct('label', '{label}', 'keys', array({', '.join(map(repr, keys))}), 'priority', {priority}, 'sure', {sure}D, 'pattern', r'(?<= )(?:{pattern})(?= )')" for label, keys, priority, sure, pattern in rules()))
    keys = sorted({k for r in rules() for k in r[1]})
    met = F.array_intersect(F.split(F.trim("_t"), " "), F.array(*[F.lit(k) for k in keys]))
    rows = docs.select((F.struct(*row) if row else F.struct(F.lit(0).alias("_none"))).alias("_row"), _words(F.col(tick(text_col))).alias("_t"))
    rows = rows.withColumns({"n_words": F.when(F.col("_t") == "  ", F.lit(0).cast("long")).otherwise((F.expr(_spaces("_t")) - 1).cast("long")), "_k": met})
    rows = rows.withColumn("_found", F.expr(f"if(size(_k) > 0, transform(array({literal}), rules -> {_FOUND})[0], cast(array() AS {_KIND}))"))
    rows = rows.withColumns({f"_base{i}": F.expr(_starts(p)) for i, p in enumerate(BASE)} | {"detections": F.expr(f"if(size(_found) = 0, _found, {_KEPT})")})
    own = [f"_base{i}" for i in range(len(BASE))]
    labels = F.concat(*[F.when(F.size(c) > 0, F.array(F.lit(label))).otherwise(F.array().cast("array<string>")) for c, label in zip(own, BASE.values(), strict=True)])
    rows = rows.withColumns({"base": F.concat(*own), "base_labels": F.array_sort(labels)})
    rows = rows.withColumns({
        "labels": F.array_sort(F.array_distinct(F.concat("base_labels", F.expr("transform(detections, d -> d.label)")))),
        "score": F.greatest(F.coalesce(F.expr("array_max(transform(detections, d -> d.sure))"), F.lit(0.0)), F.when(F.size("base") > 0, BASE_SURE).otherwise(0.0)),
    })
    return rows.select(*(["_row.*"] if row else []), *new)


def license_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), a row for each row of docs; see scans."""
    rows = scans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    return rows.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base").cast("long").alias("first_word"), F.array_max("base").cast("long").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )
