"""License scanning with ordered signature rules.

A text becomes its words, ASCII letters in lower case, each padded by a blank on
both sides, so that no two matches share a blank and places are counted in words.
The rules of ``license_rules`` run where their keyword stands in the text, and
keywords are sought where one of a few beginnings of words does. A
detection goes if its interval lies within that of another of higher priority, or
within a longer one (or an equal one of an earlier rule) of the same priority.
The base phrases are counted beside the rules and are never suppressed.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, stored
from .license_rules import TRUST, rules

# Fixed values of the contract: phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def padded_words(text: Column) -> Column:
    """The words of a text, each between two blanks of its own, and one more blank at either end."""
    # Of characters beyond ASCII, these two alone have ASCII letters in their lower case.
    odd = F.contains(text, F.lit("\u0130")) | F.contains(text, F.lit("\u212a"))
    lowered = F.when(odd, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.regexp_replace(F.concat(F.lit(" "), lowered, F.lit(" ")), BREAK, "  ")


def word_count(padded: Column) -> Column:
    """Words in a stretch of padded words; the blank at an end doesn't count."""
    return F.shiftright(F.length(padded) - F.length(F.replace(padded, F.lit(" "), F.lit(""))), 1).cast("long")


def phrase_places(padded: Column, n_words: Column, phrase: str, label: str) -> Column:
    """struct<label, n, first, last> of the places of one phrase, null without any."""
    sought = f" {phrase.replace(' ', '  ')} "
    pieces = F.split(padded, sought, -1)
    n = F.size(pieces) - 1
    last = n_words - word_count(F.element_at(pieces, -1)) - len(phrase.split())
    places = F.struct(F.lit(label).alias("label"), n.cast("long").alias("n"), word_count(pieces[0]).alias("first"), last.alias("last"))
    return F.when(F.contains(padded, F.lit(sought)), places)


def rule_hits(padded: Column) -> Column:
    """array<struct<rank, priority, label, parts>>, one entry for each rule that matches.

    ``parts`` has (words between, words matched) of each match in order: ``split``
    and ``regexp_extract_all`` walk the same matches.
    """
    by_stem: dict[str, list[Column]] = {}
    for rank, r in enumerate(rules()):
        fields = {"rank": rank, "priority": r.priority, "label": r.label, "keyword": r.keyword, "pattern": r.pattern}
        by_stem.setdefault(r.stem, []).append(F.struct(*[F.lit(v).alias(k) for k, v in fields.items()]))
    known = F.array(*[F.struct(F.lit(s).alias("stem"), F.array(*r).alias("rules")) for s, r in by_stem.items()])
    reached = F.flatten(F.transform(F.filter(known, lambda g: F.contains(padded, g["stem"])), lambda g: g["rules"]))
    likely = F.filter(reached, lambda r: F.contains(padded, r["keyword"]))

    def parts(rule: Column) -> Column:
        between = F.transform(F.split(padded, rule["pattern"], -1), word_count)
        matched = F.transform(F.regexp_extract_all(padded, rule["pattern"], F.lit(0)), word_count)
        return F.zip_with(F.slice(between, F.lit(1), F.size(matched)), matched, lambda a, b: F.struct(a.alias("gap"), b.alias("n")))

    found = F.transform(likely, lambda r: F.struct(r["rank"].alias("rank"), r["priority"].alias("priority"), r["label"].alias("label"), parts(r).alias("parts")))
    initials = {s[1]: [t[2:] for t in by_stem if t[1] == s[1]] for s in by_stem}
    any_stem = padded.rlike(f" (?:{'|'.join(f'{c}(?:{"|".join(rest)})' for c, rest in sorted(initials.items()))})")
    return F.when(any_stem, F.filter(found, lambda r: F.size(r["parts"]) > 0))


def detections(hits: DataFrame) -> DataFrame:
    """(row_key, start, end, rank, priority, label, kept) from rows of (row_key, hits)."""
    each = hits.select("row_key", F.explode("hits").alias("h")).select("row_key", "h.rank", "h.priority", "h.label", F.posexplode("h.parts").alias("at", "part"))
    in_rule = Window.partitionBy("row_key", "rank").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = each.withColumn("end", F.sum(F.col("part.gap") + F.col("part.n")).over(in_rule)).withColumn("start", F.col("end") - F.col("part.n"))
    # What contains a detection stands before it in this order, so the farthest end of each priority tells.
    before = Window.partitionBy("row_key").orderBy("start", F.desc("end"), "priority", "rank").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.lit(False)
    for p in range(len(TRUST)):
        reach = F.max(F.when(F.col("priority") == p, F.col("end"))).over(before)
        inside = inside | ((F.col("priority") >= p) & F.coalesce(reach >= F.col("end"), F.lit(False)))
    return placed.select("row_key", "start", "end", "rank", "priority", "label", (~inside).alias("kept"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, n_words, base, detections, score.

    ``base`` is array<struct<label, n, first, last>> of the base phrases that
    occur, places in words from 0. ``detections`` is array<struct<start, end, rank,
    priority, label>> of what suppression leaves, by start, end exclusive. ``score``
    is the trust in the strongest of both, 0 without any. A null text is empty; a
    text without words has neither; ids may be null or repeat, each row has its
    own result; an empty table gives none. Columns other than the two named are
    not read.
    """
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    words = docs.select(col(id_col).alias("id"), text.alias("body")).select("id", padded_words(F.col("body")).alias("padded")).select("id", "padded", (word_count(F.col("padded")) - 1).alias("n_words"))
    base = F.array_compact(F.array(*[phrase_places(F.col("padded"), F.col("n_words"), p, label) for p, label in PHRASES]))
    scanned = stored(
        words.select("id", "n_words", base.alias("base"), rule_hits(F.col("padded")).alias("hits")).withColumn("row_key", F.monotonically_increasing_id()), "licenses"
    )
    kept = (
        detections(scanned.where(F.size("hits") > 0))
        .where("kept")
        .groupBy("row_key")
        .agg(F.sort_array(F.collect_list(F.struct("start", "end", "rank", "priority", "label"))).alias("found"))
    )
    none = F.array().cast("array<struct<start:bigint,end:bigint,rank:int,priority:int,label:string>>")
    trust = F.array(*[F.lit(t) for t in TRUST])
    sure = F.array_max(F.transform("detections", lambda d: F.element_at(trust, d["priority"] + 1)))
    return (
        scanned.join(kept, "row_key", "left")
        .select("id", "n_words", "base", F.coalesce("found", none).alias("detections"))
        .withColumn("score", F.greatest(F.lit(0.0), F.coalesce(sure, F.lit(0.0)), F.when(F.size("base") > 0, TRUST[-1]).otherwise(0.0)))
    )
