"""Place names in titles and notes: labels, counts over time, roll-ups."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import place_key
from tessera.operators.biblio import with_share
from tessera.operators.text import count_tfidf

#: Names under which a modern place is kept.
CANONICAL = (("chengdu plain", "Chengdu"), ("guangdong province", "Guangdong"), ("shandong province", "Shandong"), ("sichuan province", "Sichuan"))


def canonical_name(name: Column) -> Column:
    out = None
    for key, modern in CANONICAL:
        out = F.when(place_key(name) == key, modern) if out is None else out.when(place_key(name) == key, modern)
    return out.otherwise(name)


def clean_name(name: Column) -> Column:
    """Without code-point marks, phrases like 'old name of' and what follows 'northern part of'."""
    t = F.regexp_replace(name, r"<U\+[0-9A-Fa-f]+>", " ")
    t = F.regexp_replace(t, r"(?i)\b(?:currently|currently known as|the old name of|old name of)\b", " ")
    t = F.regexp_replace(t, r"(?i)\bnorthern part of\b.*$", " ")
    return F.btrim(F.regexp_replace(t, r"\s+", " "), F.lit(" .,*"))


def place_label(modern: Column, historical: Column) -> Column:
    """'modern（old; old）' of the old names that differ from the modern one; historical: sorted distinct names."""
    olds = F.filter(historical, lambda o: (o != "") & (place_key(o) != place_key(modern)))
    return F.when(F.size(olds) > 0, F.concat(modern, F.lit("（"), F.array_join(olds, "; "), F.lit("）"))).otherwise(modern)


def place_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """Mentions of each place by `keys`, with the old names seen there and the label they give,
    the share within the first key, and tf-idf by label over windows."""
    out = rows.groupBy(*keys, "modern_name").agg(F.count("*").alias("count"), F.countDistinct("master_id").alias("article_count"), F.sort_array(F.collect_set("historical_name")).alias("_olds"))
    out = out.withColumn("historical_names", F.array_join("_olds", "; ")).withColumn("place_label", place_label(F.col("modern_name"), F.col("_olds"))).drop("_olds")
    return count_tfidf(with_share(out, "count", [keys[0]]), "place_label", keys[0], "count")


def rollup(rows: DataFrame, place: str, province: str, window: str) -> DataFrame:
    """Mentions by place and by province, with the windows they occur in."""
    windows = F.array_join(F.sort_array(F.collect_set(window)), ",").alias("windows")
    one = rows.groupBy(F.lit("place").alias("level"), F.col(place).alias("name")).agg(F.count("*").alias("count"), windows)
    return one.unionByName(rows.groupBy(F.lit("province").alias("level"), F.col(province).alias("name")).agg(F.count("*").alias("count"), windows))


def mentions(texts: DataFrame, names: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name) of gazetteer names whose words stand in the text, as runs of up to three words."""
    words = F.split(place_key(text), " ")
    runs = F.flatten(F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: F.transform(F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: i + n - 1 <= F.size(words)), lambda i: F.array_join(F.slice(words, i, n), " "))))
    return texts.select(key, F.explode(F.array_distinct(runs)).alias("_key")).join(names.select("name", place_key("name").alias("_key")).where("_key != ''"), "_key").select(key, "name")


# Old names and the modern place of each, in natural order.
GAZETTEER = {
    "batang": "Batang",
    "cambodia": "Cambodia",
    "canton": "Guangzhou",
    "cheh-kiang": "Zhejiang Province",
    "ch'eng tu": "Chengdu",
    "cheng tu": "Chengdu",
    "chinkiang": "Zhenjiang",
    "foochow": "Fuzhou",
    "formosa": "Taiwan",
    "fukien": "Fujian Province",
    "hangchow": "Hangzhou",
    "hangkow": "Hangzhou",
    "hankow": "Hankou",
    "honan": "Henan Province",
    "huangho": "Yellow River",
    "hunan": "Hunan",
    "kaifungfu": "Kaifengfu",
    "kansu": "Gansu Province",
    "kambodia": "Cambodia",
    "kwang tung": "Guangdong Province",
    "kwang-tung": "Guangdong Province",
    "kwangtung": "Guangdong Province",
    "kwangsi": "Guangxi Province",
    "kweichow": "Guizhou",
    "lampacao": "Lampacau",
    "menkong": "Mangkang",
    "pekin": "Beijing",
    "quang-tung": "Guangdong Province",
    "quang tang": "Guangdong Province",
    "rangoon": "Yangon",
    "saghalien": "Sakhalin",
    "shan tung": "Shandong Province",
    "shan-hsi": "Shanxi Province",
    "shantung": "Shandong Province",
    "shen-hsi": "Shaanxi Province",
    "shaohing": "Shaoxing",
    "ssuch'uan": "Sichuan",
    "sungp'an": "Songpan",
    "sze chuen": "Sichuan Province",
    "szechuen": "Sichuan",
    "szemao": "Pu'er",
    "t'ai shan": "Tai Shan",
    "tai shan": "Tai Shan",
    "tong-king": "Tonkin",
    "wenchow": "Wenzhou",
    "woosung": "Wusong",
    "yang - tsze kiang": "Yangtzi River",
    "yang-tsze kiang": "Yangtzi River",
    "yangtse": "Yangtzi River",
    "yentai hill": "Yantai Hill",
}
# Words that tell a place from another name, and names that are places without one.
PLACE_WORDS = ("province", "river", "island", "plain", "city", "hill", "valley", "coast", "wall", "fu")
OTHER_WORDS = ("dynasty", "book", "dream of", "church", "gong", "tang", "tribe", "zu", "zi", "emperor", "commander")
PLAIN_PLACES = ("canton", "formosa", "hankow", "hunan", "pekin", "shantung", "kwangsi", "kweichow", "foochow", "rangoon", "honan", "kansu")


def plain_key(name: str) -> str:
    """place_key() of a listed name."""
    return re.sub("[^a-z0-9]+", " ", name.lower().replace("ü", "u")).strip()


def note_segments(notes: Column) -> Column:
    """Cleaned parts, by ',' within ';', of a cataloguer's note."""
    t = F.regexp_replace(F.coalesce(notes, F.lit("")), r"<U\+FF1B>|；", ";")
    t = F.regexp_replace(F.regexp_replace(t, r"<U\+FF0C>|，", ","), r"<U\+[0-9A-Fa-f]+>", " ")
    parts = lambda s: F.filter(F.transform(F.split(s, ","), clean_name), lambda p: p != "")
    return F.filter(F.transform(F.split(t, ";"), parts), lambda p: F.size(p) > 0)


def note_places(rows: DataFrame, key: str, notes: str, gazetteer: Mapping[str, str] = GAZETTEER) -> DataFrame:
    """(key, historical_name, modern_name, place_label) of the places that notes name.

    A segment's first part names the place: by the longest gazetteer name in it, else as it
    stands. Its modern name is the gazetteer's, where the old name is an entry as it is
    compared, else the next part with a letter, else the old name. What holds none of the
    words for places, and isn't listed, is left out.
    """
    listed = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(plain_key(n)).alias("key"), F.lit(m).alias("modern")) for n, m in sorted(gazetteer.items(), key=lambda x: -len(x[0]))])
    def made(rows: DataFrame, **columns: Column) -> DataFrame:
        """Adds columns behind an explode: what follows reads them, for each listed name too, and doesn't make them anew."""
        one = F.struct(*[c.alias(n) for n, c in columns.items()])
        return rows.select("*", F.explode(F.array(one)).alias("_one")).select(*rows.columns, *[F.col("_one")[n].alias(n) for n in columns])

    parts = rows.select(key, F.explode(note_segments(F.col(notes))).alias("_p"))
    parts = made(parts, _first=F.get("_p", 0), _sought=place_key(F.get("_p", 0)))
    entry = F.get(F.filter(listed, lambda g: (g["key"] != "") & F.contains("_sought", g["key"])), 0)["name"]
    parts = made(parts, _old=F.coalesce(entry, "_first"))
    parts = made(parts, _key=place_key("_old"))
    entry = F.get(F.filter(listed, lambda g: g["name"] == F.col("_key")), 0)["modern"]
    later = F.get(F.filter(F.slice("_p", F.lit(2), F.size("_p")), lambda p: p.rlike("[A-Za-z]")), 0)
    parts = made(parts, _entry=entry, _later=later)
    parts = made(parts, _new=F.coalesce("_entry", "_later", clean_name(F.col("_old"))))
    parts = made(parts, _both=F.concat_ws(" ", "_key", place_key("_new")))
    has = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains("_both", w))
    known = F.col("_entry").isNotNull() | has(PLACE_WORDS) | ~has(OTHER_WORDS) & F.col("_key").isin(*PLAIN_PLACES)
    old, new = clean_name(F.col("_old")), canonical_name(clean_name(F.col("_new")))
    return parts.where(known).select(key, old.alias("historical_name"), new.alias("modern_name"), place_label(new, F.array(old)).alias("place_label"))


def article_places(rows: DataFrame) -> DataFrame:
    """One row per article, window and modern name: its old names there and their label."""
    out = rows.groupBy("master_id", "time_window", "modern_name").agg(F.sort_array(F.collect_set("historical_name")).alias("_olds"))
    return out.select("master_id", "time_window", "modern_name", F.array_join("_olds", "; ").alias("historical_names"), place_label(F.col("modern_name"), F.col("_olds")).alias("place_label"))


def name_mapping(rows: DataFrame) -> DataFrame:
    """Old names with their modern name, and in how many articles they stand."""
    return rows.groupBy("historical_name", "modern_name").agg(F.countDistinct("master_id").alias("article_count"))
