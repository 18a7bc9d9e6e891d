"""License scans: written signature rules over a text's words, in DataFrame functions only.

A rule is a regular expression with a keyword that all its matches contain, a label and a
priority. A rule is tried only where its keyword occurs, and a text without any keyword
is never matched. A
detection that lies within a detection of higher priority, or within a longer one of its
own, is suppressed. All of it is one projection of a row: there is no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.license_rules import SIGNATURES
from tessera.llm.shared import table

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Fixed by the query's contract: phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: How sure a detection of each priority makes a license; a negation says that there is none.
STRENGTH = {1: 0.2, 2: 0.5, 3: 0.8, 4: 0.9, 5: 1.0, 6: 0.0}


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    regex: str
    priority: int


def built_in_rules() -> list[Rule]:
    """The written signatures, in their order."""
    return [Rule(label, keyword, regex, priority) for label, priority, keyword, regex in SIGNATURES]


#: Parts that many keywords share. A keyword is sought only where its part occurs, and a
#: keyword with none of them is its own part, so they change the cost and not what is found.
PARTS = ("licen", "identifier", "gpl", "public", "software", "exception", "apache", "bsd", "cc by", "cc0", "commons", "under the ", "redistribut", "proprietary", "not ", "mpl", "epl", "cddl", "the gnu", "openssl", "same terms as")


def gates(rules: list[Rule]) -> dict[str, list[str]]:
    """The rules' keywords by the part that they contain: a text with none of the parts has no match."""
    out: dict[str, list[str]] = {}
    for keyword in dict.fromkeys(r.keyword for r in rules):
        out.setdefault(next((p for p in PARTS if p in keyword), keyword), []).append(keyword)
    return out


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _tried(words: Column, rules: list[Rule]) -> Column:
    """array<struct<rule, label, priority, regex>>: the rules whose keyword occurs."""
    one = lambda k, r: F.struct(F.lit(k).alias("rule"), F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"), F.lit(f"(?<= )(?:{r.regex})(?= )").alias("regex"))
    own = lambda keyword: F.array(*[one(k, r) for k, r in enumerate(rules) if r.keyword == keyword])
    table = F.array(*[F.struct(F.lit(part).alias("part"), F.array(*[F.struct(F.lit(k).alias("keyword"), own(k).alias("rules")) for k in keywords]).alias("keywords")) for part, keywords in gates(rules).items()])
    keywords = F.flatten(F.transform(F.filter(table, lambda g: F.contains(words, g["part"])), lambda g: g["keywords"]))
    return F.flatten(F.transform(F.filter(keywords, lambda g: F.contains(words, g["keyword"])), lambda g: g["rules"]))


def detections(words: Column, rules: list[Rule]) -> Column:
    """array<struct<s, e, priority, rule, label>> of all matches, in words from 0, end exclusive,
    by start, then the longest, the highest priority and the first rule.

    `words` is a text's words with one space before, between and after.
    """
    tried = F.transform(
        _tried(words, rules),
        lambda r: F.struct(r.alias("r"), F.split(words, r["regex"], -1).alias("between"), F.regexp_extract_all(words, r["regex"], F.lit(0)).alias("hits")),
    )
    kind = "array<struct<s:bigint,e:bigint,priority:int,rule:int,label:string>>"

    def places(x: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + _spaces(F.get(x["between"], i))
            end = start + _spaces(F.get(x["hits"], i)) + 1
            one = F.struct(start.cast("bigint").alias("s"), end.cast("bigint").alias("e"), x["r"]["priority"].alias("priority"), x["r"]["rule"].alias("rule"), x["r"]["label"].alias("label"))
            return F.struct((end - 1).cast("bigint").alias("at"), F.concat(acc["out"], F.array(one)).cast(kind).alias("out"))

        first = F.struct(F.lit(-1).cast("bigint").alias("at"), F.array().cast(kind).alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(x["hits"]) - 1), first, step, lambda acc: acc["out"])

    found = F.flatten(F.transform(F.filter(tried, lambda x: F.size(x["hits"]) > 0), places))
    keyed = F.transform(found, lambda d: F.struct(d["s"].alias("s"), (-d["e"]).alias("e"), (-d["priority"]).alias("priority"), d["rule"].alias("rule"), d["label"].alias("label")))
    return F.transform(F.sort_array(keyed), lambda d: F.struct(d["s"].alias("s"), (-d["e"]).alias("e"), (-d["priority"]).alias("priority"), d["rule"].alias("rule"), d["label"].alias("label")))


def unsuppressed(found: Column) -> Column:
    """Those of detections(), which are sorted, that no earlier one of as high a priority contains."""
    kind = "array<struct<s:bigint,e:bigint,priority:int,rule:int,label:string>>"
    first = F.struct(*[F.lit(-1).cast("bigint").alias(f"m{p}") for p in STRENGTH], F.array().cast(kind).alias("out"))

    def step(acc: Column, d: Column) -> Column:
        reached = F.element_at(F.array(*[acc[f"m{p}"] for p in STRENGTH]), d["priority"])
        out = F.when(reached >= d["e"], acc["out"]).otherwise(F.concat(acc["out"], F.array(d)).cast(kind))
        return F.struct(*[F.when(d["priority"] >= p, F.greatest(acc[f"m{p}"], d["e"])).otherwise(acc[f"m{p}"]).alias(f"m{p}") for p in STRENGTH], out.alias("out"))

    return F.aggregate(found, first, step, lambda acc: acc["out"])


def scan(documents: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    Words are runs of letters, digits and non-ASCII characters of the lower-cased text. Base
    phrases always count; the rules' detections add labels. score is that of the surest
    detection (STRENGTH); a base phrase counts as a title. Null and empty texts have no words, empty
    label strings, score 0 and null places. Whole texts are read; repeated rows and null
    ids stay; other columns are ignored.
    """
    base = [Rule(label, "license", phrase, 2) for phrase, label in BASE]
    rules = rules or built_in_rules()
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), UPPER, UPPER.lower()), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", " ")), F.lit(" ")).alias("words"))
    words, kind = F.col("words"), "array<struct<s:bigint,e:bigint,priority:int,rule:int,label:string>>"
    gate = F.lit(False)
    for g in gates(base + rules):
        gate = gate | F.contains(words, F.lit(g))
    empty = F.array().cast(kind)
    texts = texts.select("doc_id", F.when(words == "  ", 0).otherwise(_spaces(words) - 1).cast("long").alias("n_words"), F.when(gate, words).alias("words"))
    found = texts.select("doc_id", "n_words", F.when(words.isNotNull(), detections(words, base)).otherwise(empty).alias("base"), F.when(words.isNotNull(), unsuppressed(detections(words, rules))).otherwise(empty).alias("found"))
    labels = lambda c: F.transform(c, lambda d: d["label"])
    strength = F.array(*[F.lit(STRENGTH[p]) for p in sorted(STRENGTH)])
    best = F.array_max(F.transform(F.concat("base", "found"), lambda d: F.element_at(strength, d["priority"])))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda d: d["s"])).alias("first_word"),
        F.array_max(F.transform("base", lambda d: d["s"])).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(labels(F.col("base")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(labels(F.col("base")), labels(F.col("found"))))), ",").alias("labels"),
        F.coalesce(best, F.lit(0.0)).cast("double").alias("score"),
        F.col("found").alias("detections"),
    )


def op3_signature_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of all documents."""
    return scan(table(spark, sf_dir, "documents")).drop("detections")
