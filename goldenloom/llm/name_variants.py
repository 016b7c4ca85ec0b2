"""Variant spellings of names typed by people.

Every name is read into canonical words: legal forms, titles, noise and order
are dropped, abbreviated trades and short given names resolved. The words that
tell one party from another (a firm's invented word, a person's surname) are
points of a metric space, the words of all records together; an exact radius
join by metric-space partitioning (:mod:`goldenloom.llm.metric`) gives every two
words within two edits, and every word itself at distance 0. Nothing is linked
by words but along these pairs.

What else the records say only filters the pairs. Two records are linked when
they have near words and agree on a value beside the name: a tax number, phone
or mail address, or, if the branch of the firm or the initial of the person is
the same too, a mail domain or a building. A firm typed by its initials ("BG KG")
is linked to those it may stand for on such a value. A company typed without any such value counts by its
full canonical name, and a far rarer misspelling of it without a domain is linked
to the one better known firm of the same trade within one edit. Links of records
with equal words are stars to the smallest id, so a value or name held by a third
of all rows adds one link a row. Linked records form groups; the variants of a
group are paired.

Pairs of near words meet the values in one of two ways that give the same
links: the words of a value with at most CROWD words are paired and looked up
among the near pairs; of a more crowded value each word looks up its near words
instead, so no value's words are paired out.

Defined results: a name without letters or digits takes no part; records whose
names have the same letters and digits are not variants; an employee's name
is of another kind than the employer's and is never linked to it; second
deliveries are one record; rows without id are ignored; empty tables give no
pairs; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldenloom.llm.evidence import PARTY, evidence, open_domains, parties
from goldenloom.llm.metric import near_points
from goldenloom.llm.naming import BRANCHES, Name, acronym, given_names
from goldenloom.operators.components import components
from goldenloom.session import Scratch

#: One in RATIO rows of a firm may carry one certain misspelling of its name; SURE standard deviations are allowed for.
RATIO, SURE = 20, 1.165
#: Stand for the words of firms whose initials are their key: written out, or nothing but initials.
LONG, BRIEF = "=", "-"
#: Words of a value that are paired directly.
CROWD = 32


def is_firm(n: Name) -> bool:
    return n.firm or (len(n.core) == 1 and not n.given and not n.initials)


def key_words(n: Name) -> list[str]:
    if is_firm(n):
        return [w for w in n.core if len(w) >= 4] or n.core
    return [w for w in n.surname.split() if len(w) > 2] or ([n.given] if n.given else [])


def signatures(n: Name) -> list[str]:
    """What must agree besides on weaker values: a firm's branches, a person's first initial."""
    if is_firm(n):
        return ["+".join(sorted({w for w in n.trades if w in BRANCHES}))]
    names = {n.given, *given_names(n.given)} if n.given else set(n.core)
    return sorted({g[0] for g in names if g})


def _initials(n: Name) -> str | None:
    if len(n.core) == 1 and len(n.core[0]) > 4:
        return "".join(sorted(acronym(n)))
    if len(n.core) == 1 and not n.trades:
        return "".join(sorted(n.core[0]))
    return None


ROWS = "rec string, bare string, firm boolean, words array<string>, signs array<string>, initials string, trades string, whole string, values array<string>"


def read_names(records: DataFrame, domains: frozenset[str], spaces: str) -> DataFrame:
    """Names in the spaces c (customers), s (suppliers) and k (companies), read into words, with the record's values.

    rec is the space and the id; firms' own names stand beside company names as k=id, without ``bare``.
    """
    import pyarrow as pa

    types = [pa.string(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.list_(pa.string())]
    names = [c.split()[0] for c in ROWS.split(", ")]

    def run(batches: Iterator) -> Iterator:
        known: dict[str, tuple] = {}

        def read(text: str | None) -> tuple:
            text = text or ""
            if text not in known:
                if len(known) > 100_000:
                    known.clear()
                n = Name(text)
                firm = is_firm(n)
                words = key_words(n)
                whole = "".join(sorted(n.core)) if firm and n.trades and not n.cut and any(len(w) >= 5 for w in words) else None
                known[text] = (n.bare, firm, words, signatures(n), _initials(n) if firm else None, "+".join(sorted(set(n.trades))) if firm else "", whole)
            return known[text]

        for batch in batches:
            out: list[list] = [[] for _ in names]
            for i, name, comp, email, phone, address, city, tax in zip(*(batch.column(k).to_pylist() for k in range(len(PARTY)))):
                values = evidence(email, phone, address, city, tax, domains)
                for space in spaces:
                    typed = [(space + i, read(comp if space == "k" else name), True)]
                    if space == "k" and read(name)[1]:
                        typed.append(("k=" + i, read(name), False))
                    for rec, n, own in typed:
                        if n[0]:
                            for col, v in zip(out, (rec, n[0] if own else None, *n[1:], values)):
                                col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    return records.select(*PARTY).mapInArrow(run, ROWS)


def keyed(rows: DataFrame) -> DataFrame:
    """(rec, key, word) of names; records of one key with near words are linked.

    The key's first letter is F or P (firms, persons: a value, with a sign where it is a weak one), A (initials and a value), N (trades of a
    company whose words must be the same), x or w (trades of a company with or without a domain that says how it is spelt).
    """
    rows = rows.withColumn("space", F.substring("rec", 1, 1))
    company = F.col("space") == "k"
    letter = F.substring("v", 1, 1)
    valued = rows.select("*", F.explode("values").alias("v"))
    strong = (letter.isin("t", "m")) | (~company & (letter == "p"))
    signs = F.when(strong, F.array(F.lit(""))).otherwise(F.col("signs"))
    plain = valued.select("rec", "space", "firm", "v", "words", F.explode(signs).alias("sign")).select(
        "rec", F.concat_ws("|", F.when(F.col("firm"), "F").otherwise("P"), "space", "sign", "v").alias("key"), F.explode("words").alias("word")
    )
    brief = valued.where(F.col("initials").isNotNull() & letter.isin("t", "p", "m", "d")).select(
        "rec", F.concat_ws("|", F.lit("A"), "space", "initials", "v").alias("key"), F.when(F.exists("words", lambda w: F.length(w) > 4), LONG).otherwise(BRIEF).alias("word")
    )
    firms = rows.where(company & F.col("firm") & (F.col("trades") != ""))
    whole = firms.where("whole IS NOT NULL").select("rec", F.concat(F.lit("N|"), "trades").alias("key"), F.col("whole").alias("word"))
    own = F.when(F.exists("values", lambda v: v.startswith("d")), "x|").otherwise("w|")
    trades = firms.select("rec", F.concat(own, "trades").alias("key"), F.explode("words").alias("word")).where(F.length("word") >= 6)
    return plain.unionByName(brief).unionByName(whole).unionByName(trades)


def close(spots: DataFrame, near: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): the lowest records of every two near words of one key; spots are (key, word, low)."""
    alike = near.where("a <> b AND (least(length(a), length(b)) >= 6 OR (least(length(a), length(b)) >= 4 AND one))").select("a", "b")
    sizes = spots.groupBy("key").agg(F.count("*").alias("words")).where("words > 1")
    many = scratch.save(spots.join(sizes, "key"), "shared")
    x, y = (many.select("key", "words", F.col("word").alias(w), F.col("low").alias(f"low_{w}")) for w in "ab")
    few = x.where(F.col("words") <= CROWD).join(y.drop("words"), "key").where("a < b").join(alike, ["a", "b"]).select("low_a", "low_b")
    crowd = x.where(F.col("words") > CROWD).join(alike, "a").join(y.drop("words"), ["key", "b"]).select("low_a", "low_b")
    return few.unionByName(crowd).select(F.col("low_a").alias("a"), F.col("low_b").alias("b"))


def guessed(spots: DataFrame, near: DataFrame, scratch: Scratch) -> DataFrame:
    """(space, word, a, b): a word on rows without a domain that misspells the one better known word of the trade within one edit."""
    trades = spots.select(F.substring("key", 3, 1_000_000).alias("space"), F.substring("key", 1, 1).alias("own"), "word", "low", "n")
    whole = trades.groupBy("space", "word").agg(F.min("low").alias("low"), F.sum("n").alias("n"), F.min(F.when(F.col("own") == "w", F.col("low"))).alias("lone"))
    whole = scratch.save(whole, "trades")
    edges = near.where("one AND a <> b")
    edges = edges.select(F.col("a").alias("word"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("word"), F.col("a").alias("other")))
    better = whole.select("space", F.col("word").alias("other"), F.col("low").alias("b"), F.col("n").alias("m"))
    known = whole.join(edges, "word").join(better, ["space", "other"]).where("m > n")
    likely = F.col("m") >= RATIO * F.pow(F.greatest(F.lit(0.0), F.sqrt("n") - SURE), F.lit(2.0))
    known = scratch.save(known.where(likely | (F.col("m") >= RATIO * F.col("n"))), "guesses")
    bent = known.where(F.col("m") >= RATIO * F.col("n")).select("space", F.col("word").alias("other")).distinct().withColumn("bent", F.lit(1))
    # Another misspelling of the better known word is no second firm.
    known = known.where("lone IS NOT NULL").join(bent, ["space", "other"], "left").withColumn("bent", F.coalesce("bent", F.lit(0)))
    guess = known.groupBy("space", "word", F.col("lone").alias("a")).agg(
        F.min(F.struct("bent", "b")).alias("best"), F.count_if(F.col("bent") == 0).alias("firms"), F.count("*").alias("n")
    )
    return guess.where("firms = 1 OR firms = 0 AND n = 1").select("space", "word", "a", F.col("best.b").alias("b"))


def links(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b) between records that share a key and have equal or near words."""
    keys = keyed(rows)
    spots = scratch.save(keys.groupBy("key", "word").agg(F.min("rec").alias("low"), F.count("*").alias("n")), "spots")
    letters = F.col("key").startswith("A|")
    near = scratch.save(near_points(spots.where(~letters).select("word")), "near")
    brief = spots.where(letters & (F.col("word") == BRIEF)).select("key", "low")
    brief = keys.where(letters).join(brief, "key").where("rec <> low").select(F.col("rec").alias("a"), F.col("low").alias("b"))
    spots = scratch.save(spots.where(~letters).join(near.where("distance = 0").select(F.col("a").alias("word")), "word"), "points")
    alone = F.col("key").rlike(r"^[xw]\|")
    stars = keys.where(~alone & ~letters).join(spots.where(~alone & (F.col("n") > 1)).select("key", "word", "low"), ["key", "word"]).where("rec <> low")
    stars = stars.select(F.col("rec").alias("a"), F.col("low").alias("b"))
    sure = close(spots.where(F.col("key").rlike(r"^[FP]\|")).select("key", "word", "low"), near, scratch)
    guess = guessed(spots.where(alone), near, scratch)
    # The other rows without a domain that have such a word go with it.
    fellows = keys.where(F.col("key").startswith("w|")).select(F.substring("key", 3, 1_000_000).alias("space"), "word", "rec")
    fellows = fellows.join(guess.select("space", "word", "a"), ["space", "word"]).where("rec <> a").select("a", F.col("rec").alias("b"))
    return stars.unionByName(brief).unionByName(sure).unionByName(guess.select("a", "b")).unionByName(fellows)


def variants(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(space, id1, id2), id1 < id2, of every two records of a space whose names are variants of one party's name."""
    groups = scratch.save(components(scratch.save(links(rows, scratch).distinct(), "links")), "groups")
    typed = rows.where("bare IS NOT NULL").select(F.col("rec").alias("id"), "bare").join(groups, "id")
    left, right = (typed.select("component", F.col("id").alias(f"id{k}"), F.col("bare").alias(f"bare{k}")) for k in (1, 2))
    both = left.join(right, "component").where("id1 < id2 AND bare1 <> bare2")
    return both.select(F.substring("id1", 1, 1).alias("space"), *[F.substring(c, 2, 1_000_000).alias(c) for c in ("id1", "id2")])


def found(spark: SparkSession, d: str) -> DataFrame:
    customers, suppliers = (parties(spark, d, s) for s in ("customers", "suppliers"))
    domains = open_domains(customers.unionByName(suppliers))
    scratch = Scratch(spark, "names")
    rows = read_names(customers, domains, "ck").unionByName(read_names(suppliers, domains, "s"))
    pairs = variants(scratch.save(rows, "rows"), scratch)
    return pairs.select(F.when(F.col("space") == "k", "company").otherwise("name").alias("field"), "id1", "id2")


QUERIES = {"p1_found": found}
ORACLES: dict[str, str] = {}
