"""Same postal address written differently: multi-pass sorted neighbourhoods.

An address and its city are parsed into house number, direction, street name,
street type and town; units, floors and postcodes are taken out, and a town
that is missing is looked up by the postcode, which most rows write beside it.
Rows that parse alike are one class. Classes are sorted by three differing
orders of their components; in each order a class is compared with its WINDOW
successors. House numbers and directions must be equal; streets and towns may
differ by edits and swapped letters, unless both spellings are common in the
corpus, which makes them two names ("Ridge", "Bridge"); a spelling far rarer
than one near to it is a misspelling, however many rows it has. Orders are cut into
buckets of bounded size that overlap by a window, so no task grows with a
frequent number, street or town.

The order (number, street, town) leaves more than WINDOW classes between two
spellings of one town only where a street and number occur in that many towns;
classes that agree on number, direction, street and postcode or on number,
direction, town and the letters of the street regardless of their order are
joined on those values besides, whatever lies between them.

Defined results: rows without id or address, or with an address that names no
number or no street, pair with nothing; an unknown town pairs with nothing;
second deliveries of an id are one record; repeated addresses pair with each
other; empty tables give no pairs; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldenloom.session import Scratch, table

WINDOW = 20
BUCKET = 4_096
#: A spelling is common if at least COMMON addresses have it and no near spelling is in RATIO times as many.
COMMON, RATIO = 15, 20

# Street types and their abbreviations, by canonical type.
_TYPES = {
    "street": "street strasse straat str st", "road": "road rd", "avenue": "avenue avenida avda avd ave av",
    "boulevard": "boulevard blvd boul bd bld", "drive": "drive drv dr", "lane": "lane ln la", "square": "square sq",
    "court": "court crt ct", "place": "place plaza platz plein pza plza plz pln plc pl", "way": "way wy", "terrace": "terrace ter",
    "rue": "rue r", "chemin": "chemin chem che ch", "quai": "quai q", "allee": "allee all", "calle": "calle cl c",
    "paseo": "paseo ps po", "gasse": "gasse gss", "laan": "laan", "kade": "kade kd", "weg": "weg wg",
}
TYPES = {w: t for t, words in _TYPES.items() for w in words.split()}
# Endings of German and Dutch street names.
_ENDINGS = {
    "strasse": "street", "straat": "street", "platz": "place", "plein": "place", "gasse": "gasse", "allee": "allee",
    "laan": "laan", "kade": "kade", "weg": "weg", "str": "street", "pln": "place",
}
_SHORT = {"pln": "plein", "plz": "platz", "gss": "gasse", "all": "allee", "ln": "laan", "kd": "kade", "wg": "weg", "pl": "platz", "g": "gasse"}
_DOTTED = re.compile(r"(?<=[a-z]{3})(pln|plz|gss|all|ln|kd|wg|pl|g)\.(?!\w)")
_MARK = "§"
DIRECTIONS = {w: w[0] for w in ("north", "south", "east", "west", "n", "s", "e", "w")} | {"no": "n", "so": "s", "nth": "n", "sth": "s"}
ARTICLES = frozenset("de la del du des los las el le les l d der die das den van the".split())
_UNIT = re.compile(
    r"\b(?:u\.?|apt|apartment|appt|suite|ste|unit|room|rm|flat|building|bldg|bld|batiment|bat|piso|planta|puerta|floor|flr|fl|etage|stock|bus|level|lvl|po box)"
    r"\b\.?\s*(?:no\.?\s*)?#?\s*(?:\d{1,4}[a-z]?|[a-z])\b|\b\d{1,3}\.?\s*(?:og|eg|hoog|etage|stock|floor|st floor|nd floor|rd floor|th floor)\b"
)
_POST = re.compile(
    r"\b(?:[a-z]{1,2}\d[a-z\d]?\s?\d[a-z]{2}|[a-z]\d[a-z]\s?\d[a-z]\d|\d{4}\s?[a-z]{2}(?=\b)|\d{5}(?:-\d{4})?)\b"
)
_NUMBER = re.compile(r"(?:\b(?:n[or]?|num|nummer|numero|no|nr|hnr)\.?\s*|#\s*)(\d{1,4}[a-z]?)\b")
_HOUSE = re.compile(r"(?<![\w#])(\d{1,4}[a-z]?)\b")
_WORD = re.compile(rf"[^\W\d_]+|{_MARK}")
_TOWN_WORDS = {"mt": "mount", "st": "saint", "ste": "sainte", "pt": "port", "lk": "lake"}


def fold(text: str) -> str:
    text = (text or "").lower()
    if text.isascii():
        return text.replace("c/", "calle ")
    text = text.replace("ß", "ss").replace("ø", "o").replace("æ", "ae").replace("œ", "oe").replace("ł", "l")
    text = text.replace("p.º", "paseo ").replace("p.°", "paseo ").replace("c/", "calle ").replace("n°", "no ").replace("nº", "no ")
    text = unicodedata.normalize("NFKD", text)
    return re.sub(r"[‐-―]", "-", "".join(c for c in text if not unicodedata.combining(c)))


def town_of(city: str) -> tuple[str, str]:
    """(town, postcode) of a city cell."""
    text = fold(city)
    post = ""
    if m := _POST.search(text):
        post, text = re.sub(r"\s", "", m.group()), _POST.sub(" ", text)
    words = _WORD.findall(text)
    if words[:2] == ["city", "of"]:
        words = words[2:]
    return " ".join(_TOWN_WORDS.get(w, w) for w in words), post


def _split_ending(word: str) -> tuple[str, str]:
    for end, kind in _ENDINGS.items():
        if word.endswith(end) and len(word) - len(end) >= 3:
            return word[: -len(end)], kind
    return word, ""


def parse(address: str | None, city: str | None) -> tuple[str, str, str, str, str, str] | None:
    """(number, direction, street, type, town, postcode); None without a number or a street."""
    if not address or address.isspace():
        return None
    town, post = town_of(city or "")
    text = re.sub(r"[\"'`´’“”„<>]", " ", fold(address))
    text = _DOTTED.sub(lambda m: _SHORT[m.group(1)], re.sub(r"\bp\.\s?o\b\.?", "paseo ", text))
    text = _UNIT.sub(" , ", text)
    if m := _POST.search(text):
        post = post or re.sub(r"\s", "", m.group())
        text = _POST.sub(" ; ", text)
    number = ""
    if m := _NUMBER.search(text):
        number, marked = m.group(1), f"{text[: m.start()]} {_MARK} {text[m.end() :]}"
        if text[m.start()] == "#" and (h := _HOUSE.search(text[: m.start()] + " " * len(m.group()) + text[m.end() :])):
            # "# 21; 28 Oak Street": the first is a unit
            number, marked = h.group(1), f"{text[: m.start()]} , {text[m.end() : h.start()]} {_MARK} {text[h.end() :]}"
            if h.start() < m.start():
                marked = f"{text[: h.start()]} {_MARK} {text[h.end() : m.start()]} , {text[m.end() :]}"
        text = marked
    elif m := _HOUSE.search(text):
        number, text = m.group(1), f"{text[: m.start()]} {_MARK} {text[m.end() :]}"
    number = number.lstrip("0")
    if not number:
        return None
    parts = [p for p in (_WORD.findall(x) for x in re.split(r"[,;/]|\s-\s", text)) if p]
    street, others = _street_part(parts, town.split())
    if not street:
        return None
    if not town:
        if others:
            town = town_of(" ".join(others[-1]))[0]
        else:
            street, town = _trailing_town(street)
    direction, kind, core = "", "", []
    for w in street:
        if w in DIRECTIONS and not direction and len(street) > 1:
            direction = DIRECTIONS[w]
        elif w in TYPES and not kind and len(street) > 1 and (w != "la" or w is street[-1]):
            kind = TYPES[w]
        elif w not in ARTICLES:
            core.append(w)
    if not kind and core:
        core[-1], kind = _split_ending(core[-1])
    if not core:
        core, kind, direction = [kind or direction], "", ""
    return number, direction, "".join(core), kind, town, post


def _streetness(words: list[str]) -> int:
    """How sure a part is to hold the street: 3 a street type, 2 a short one or an ending."""
    score = 0
    for w in words:
        if w in TYPES and len(words) > 1 and (w != "la" or w is words[-1]):
            score = max(score, 3 if len(w) > 2 else 2)
        elif _split_ending(w)[1]:
            score = max(score, 2)
    return score


def _street_part(parts: list[list[str]], town: list[str]) -> tuple[list[str], list[list[str]]]:
    """The words of the street, without the mark of the number, and the other parts that may name the town."""
    cut = [q for p in parts if (q := _cut_town(p, town))] if town else parts
    at = next((i for i, p in enumerate(cut) if _MARK in p), -1)
    if at < 0:
        return [], []
    own = cut[at]
    rest = [p for i, p in enumerate(cut) if i != at]
    if own == [_MARK]:
        if not rest:
            return [], []
        after = cut[at + 1 :] + cut[:at]
        street = max(after, key=_streetness)
        return street, [p for p in rest if p is not street and _streetness(p) < 2]
    k = own.index(_MARK)
    before, after = own[:k], own[k + 1 :]
    if before and after:
        if len(after) == 1 and after[0] in DIRECTIONS:
            return before + after, rest
        street = before if _streetness(before) > _streetness(after) else after
        return street, [before if street is after else after, *rest]
    return before or after, [p for p in rest if _streetness(p) < 3]


def _cut_town(words: list[str], town: list[str]) -> list[str]:
    """Words without the town's, which may be misspelt or abbreviated, at either end."""
    n, whole = len(town), " ".join(town)

    def same(part: list[str]) -> bool:
        part = [_TOWN_WORDS.get(w, w) for w in part]
        return towns_near(" ".join(part), whole, False, False)

    if len(words) >= n and same(words[-n:]):
        words = words[:-n]
        return words[:-2] if words[-2:] == ["city", "of"] else words
    if len(words) >= n and same(words[:n]):
        return words[n:]
    if words[:2] == ["city", "of"] and same(words[2:]):
        return []
    return words


def _trailing_town(words: list[str]) -> tuple[list[str], str]:
    """Splits "49 Bilvusa Road Beloby" after the street type."""
    for i, w in enumerate(words):
        if 0 < i < len(words) - 1 and w in TYPES and w not in ARTICLES and len(w) > 1:
            rest = words[i + 1 :]
            if not (len(rest) == 1 and rest[0] in DIRECTIONS):
                return words[: i + 1], town_of(" ".join(rest))[0]
    return words, ""


def osa(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours as one edit; more than ``most`` is most + 1."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if older is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            row[j] = d
        if min(row) > most:
            return most + 1
    return row[-1]


def _room(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return 0 if n < 3 else 1 if n < 5 else 2


def _near(a: str, b: str, common_a: bool, common_b: bool) -> bool:
    if a == b:
        return True
    if common_a and common_b:
        return False
    room = _room(a, b)
    return bool(room) and osa(a, b, room) <= room


def towns_near(a: str, b: str, common_a: bool, common_b: bool) -> bool:
    """Equal, misspelt, or with a first word cut to its letter ("N. Selasford", "New Selasford")."""
    if a != b:
        (x, _, s), (y, _, t) = a.partition(" "), b.partition(" ")
        if s and t and x != y and min(len(x), len(y)) == 1 and x[0] == y[0]:
            return _near(s, t, False, False)
    return _near(a, b, common_a, common_b)


def same_building(a, b) -> bool:
    """Whether two classes (number, direction, street, type, town, postcode, common street, common town) are one building."""
    if a[0] != b[0] or a[1] != b[1] or (a[3] != b[3] and a[3] and b[3]):
        return False
    if not a[4] or not b[4] or not towns_near(a[4], b[4], a[7], b[7]):
        return False
    return _near(a[2], b[2], a[6], b[6])


CLASS = ("number", "direction", "street", "kind", "town", "post", "street_common", "town_common")


def parsed(records: DataFrame) -> DataFrame:
    """id and parsed components of each distinct (id, address, city)."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            ids, rows = [], []
            for i, a, c in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if (a, c) not in known:
                    if len(known) > 200_000:
                        known.clear()
                    known[a, c] = parse(a, c)
                if known[a, c]:
                    ids.append(i)
                    rows.append(known[a, c])
            cols = list(zip(*rows)) if rows else [[] for _ in range(6)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), *(pa.array(c, pa.string()) for c in cols)], ["id", *CLASS[:6]]
            )

    rows = records.where("id IS NOT NULL AND address IS NOT NULL").groupBy("id").agg(
        F.max(F.struct("ingested_at", "address", "city")).alias("r")
    )
    schema = ", ".join(f"{c} string" for c in ("id", *CLASS[:6]))
    return rows.select("id", "r.address", "r.city").mapInArrow(run, schema)


def with_towns(rows: DataFrame) -> DataFrame:
    """Fills a missing town by the town most often written beside the postcode; rows that need or have none do not take part in the join."""
    beside = rows.where("town <> '' AND post <> ''").groupBy("post", "town").agg(F.count("*").alias("n"))
    usual = beside.groupBy("post").agg(F.max(F.struct("n", "town"))["town"].alias("usual"))
    lacks = (F.col("town") == "") & (F.col("post") != "")
    filled = rows.where(lacks).join(usual, "post", "left").withColumn("town", F.coalesce("usual", F.lit(""))).select(*rows.columns)
    return rows.where(~lacks).unionByName(filled)


def shortened(word: str) -> list[str]:
    """The word and what is left of it without as many letters as it may differ by; near words share one of these."""
    out = last = {word}
    for _ in range(_room(word, word)):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out = out | last
    return sorted(out)


def with_common(classes: DataFrame) -> DataFrame:
    """Marks streets and towns whose spelling is common in the corpus and no misspelling of a far more common one; ``n`` are the rows of a class."""
    @F.pandas_udf("boolean")
    def misspelt(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_near(x, y, False, False) for x, y in zip(a, b)], dtype="bool")

    @F.pandas_udf("array<string>")
    def cuts(w: pd.Series) -> pd.Series:
        return w.map(shortened)

    for c in ("street", "town"):
        counts = classes.groupBy(c).agg(F.sum("n").alias("rows"))
        many = counts.where((F.col("rows") >= COMMON) & (F.col(c) != "")).select(F.col(c).alias("w"), "rows", F.explode(cuts(c)).alias("cut"))
        most = many.where(F.col("rows") >= COMMON * RATIO).select(F.col("w").alias("right"), F.col("rows").alias("most"), "cut")
        rare = many.join(most, "cut").where(F.col("most") >= RATIO * F.col("rows")).select("w", "right").distinct()
        rare = rare.where(misspelt("w", "right")).select(F.col("w").alias(c), F.lit(True).alias("misspelt")).distinct()
        counts = counts.where(F.col("rows") >= COMMON).join(rare, c, "left_anti").select(c, F.lit(True).alias(f"{c}_common"))
        classes = classes.join(counts, c, "left").withColumn(f"{c}_common", F.coalesce(f"{c}_common", F.lit(False)))
    return classes


def ordered(classes: DataFrame, key: str, scratch: Scratch, label: str) -> DataFrame:
    """Classes in the order of ``key``, in overlapping buckets: columns bucket, place and those of CLASS."""
    sort = classes.repartitionByRange(key).sortWithinPartitions(key, "cid").withColumn("at", F.monotonically_increasing_id())
    sort = scratch.save(sort, label)
    part = F.shiftright("at", 33)
    sizes = sort.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    starts, upto = [], 0
    for r in sizes:  # one row per partition
        starts.append((r["part"], upto))
        upto += r["n"]
    offsets = scratch.spark.createDataFrame(starts or [(0, 0)], "part bigint, start bigint")
    sort = sort.withColumn("part", part).join(F.broadcast(offsets), "part")
    sort = sort.withColumn("place", F.col("start") + F.col("at") - F.shiftleft(F.col("part"), 33))
    home = F.floor(F.col("place") / BUCKET)
    lead = (F.pmod("place", F.lit(BUCKET)) < WINDOW) & (F.col("place") >= BUCKET)
    return sort.withColumn(
        "bucket", F.explode(F.when(lead, F.array(home, home - 1)).otherwise(F.array(home)))
    ).select("bucket", "place", "cid", *CLASS)


def neighbours(classes: DataFrame, key: str, scratch: Scratch, label: str) -> DataFrame:
    """Pairs (a, b) of classes at most WINDOW places apart in the order of ``key`` that are one building."""
    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place", ignore_index=True)
        rows = list(pdf[list(CLASS)].itertuples(index=False, name=None))
        number, ids, n = pd.factorize(pdf["number"] + "|" + pdf["direction"])[0], pdf["cid"].to_numpy(), len(pdf)
        out = []
        for step in range(1, min(WINDOW, n - 1) + 1):
            for i in (number[:-step] == number[step:]).nonzero()[0]:
                if same_building(rows[i], rows[i + step]):
                    out.append((ids[i], ids[i + step]))
        return pd.DataFrame(out, columns=["a", "b"]) if out else pd.DataFrame({"a": [], "b": []}, dtype="int64")

    return ordered(classes, key, scratch, label).groupBy("bucket").applyInPandas(compare, "a bigint, b bigint")


def joined(classes: DataFrame, keys: list) -> DataFrame:
    """Pairs of classes equal on ``keys`` that are one building."""
    @F.pandas_udf("boolean")
    def same(left: pd.DataFrame, right: pd.DataFrame) -> pd.Series:
        one, two = (list(x[list(CLASS)].itertuples(index=False, name=None)) for x in (left, right))
        return pd.Series([same_building(a, b) for a, b in zip(one, two)])

    side = classes.select(*[k.alias(f"k{i}") for i, k in enumerate(keys)], "cid", F.struct(*CLASS).alias("c"))
    names = [f"k{i}" for i in range(len(keys))]
    pairs = side.select(*names, F.col("cid").alias("a"), F.col("c").alias("ca")).join(
        side.select(*names, F.col("cid").alias("b"), F.col("c").alias("cb")), names
    )
    return pairs.where("a < b").where(same("ca", "cb")).select("a", "b")


def building_pairs(records: DataFrame) -> DataFrame:
    """id1 < id2 of every two records at the same building."""
    scratch = Scratch(records.sparkSession, "addresses")
    key = ("number", "direction", "street", "kind", "town")
    rows = with_towns(scratch.save(parsed(records), "parsed")).where("town <> ''").withColumn("cid", F.xxhash64(F.struct(*key), F.lit(7)))
    rows = scratch.save(rows, "rows")
    # Everything that follows looks at classes; rows come back when the pairs of classes are known.
    classes = rows.groupBy("cid", *key).agg(F.max("post").alias("post"), F.count("*").alias("n"))
    classes = scratch.save(
        with_common(scratch.save(classes, "distinct"))
        .withColumn("k1", F.concat_ws("|", "number", "street", "town", "kind"))
        .withColumn("k2", F.concat_ws("|", "town", "number", F.reverse("street"), "kind"))
        .withColumn("k3", F.concat_ws("|", "number", F.reverse("town"), "street", "kind")),
        "classes",
    )
    letters = F.array_join(F.array_sort(F.split("street", "")), "")
    links = [neighbours(classes, k, scratch, k) for k in ("k1", "k2", "k3")]
    links.append(joined(classes.where("post <> ''"), [F.col("number"), F.col("direction"), F.col("street"), F.col("post")]))
    links.append(joined(classes, [F.col("number"), F.col("direction"), F.col("town"), letters]))
    both = links[0]
    for more in links[1:]:
        both = both.unionByName(more)
    linked = scratch.save(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")
    ids = rows.select("cid", "id")
    alike = ids.withColumnRenamed("id", "x").join(ids.withColumnRenamed("id", "y"), "cid").where("x < y").select("x", "y")
    across = (
        linked.join(ids.select(F.col("cid").alias("a"), F.col("id").alias("x")), "a")
        .join(ids.select(F.col("cid").alias("b"), F.col("id").alias("y")), "b")
        .select("x", "y")
    )
    return alike.unionByName(across).select(F.least("x", "y").alias("id1"), F.greatest("x", "y").alias("id2"))


def records_of(spark: SparkSession, d: str) -> DataFrame:
    cols = ("id", "address", "city", "ingested_at")
    return table(spark, d, "customers").select(*cols).unionByName(table(spark, d, "suppliers").select(*cols))


QUERIES = {"p6_found": lambda spark, d: building_pairs(records_of(spark, d))}
ORACLES: dict[str, str] = {}
