"""What a record says beside its name: normalised numbers, addresses of mail and buildings."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldenloom.llm.addresses import parse
from goldenloom.llm.naming import fold
from goldenloom.session import table

#: Mail domains with more than this share of all rows are looked at; one is a provider's if no firm word stands in OWN of its rows that
#: name a firm, by more than DOUBT standard deviations.
OPEN_SHARE, OWN, DOUBT = 0.002, 0.5, 1.64


def digits_of_tax(tax: str | None) -> str:
    d = re.sub(r"\D", "", tax or "")
    return d if len(d) >= 8 and len(set(d)) > 1 else ""


def digits_of_phone(phone: str | None) -> str:
    """The last ten digits, without an extension."""
    d = re.sub(r"\D", "", re.sub(r"(?i)(?:x|ext\.?)\s*\d+\s*$", "", phone or ""))[-10:]
    return d if len(d) >= 9 and len(set(d)) > 1 else ""


def parts_of_email(email: str | None) -> tuple[str, str]:
    """(local part, domain) without dots, hyphens, labels after "+" and the endings of the domain."""
    text = re.sub(r"[^a-z0-9@._+\-]", "", fold(email or ""))
    if "@" not in text:
        return "", ""
    local, domain = text.rsplit("@", 1)
    domain = re.sub(r"[.-](?:example|com|org|net|co|de|fr|es|nl|uk|us|ca|eu|info)(?=[.-]|$).*$", "", domain.strip(".-_+"))
    return re.sub(r"\W|_", "", local.split("+")[0]), re.sub(r"\W|_", "", domain)


def building(address: str | None, city: str | None) -> str:
    p = parse(address, city)
    return "|".join((p[0], p[2], p[4])) if p and p[4] else ""


def evidence(email: str | None, phone: str | None, address: str | None, city: str | None, tax: str | None, open_domains) -> list[str]:
    """Values as one letter of their kind (t, p, m, d, a) and the normalised value."""
    out = []
    if t := digits_of_tax(tax):
        out.append("t" + t)
    if p := digits_of_phone(phone):
        out.append("p" + p)
    local, domain = parts_of_email(email)
    if local and domain:
        out.append(f"m{local}@{domain}")
        if domain not in open_domains:
            out.append("d" + domain)
    if b := building(address, city):
        out.append("a" + b)
    return out


PARTY = ("id", "name", "company", "email", "phone", "address", "city", "tax_id")


def parties(spark: SparkSession, d: str, source: str) -> DataFrame:
    """One row per id of customers or suppliers with the columns of PARTY; the last delivery counts."""
    t = table(spark, d, source)
    if source == "suppliers":
        t = t.select("*", F.col("contact_email").alias("email"), F.lit(None).cast("string").alias("company"))
    best = F.max(F.struct("ingested_at", *PARTY[1:])).alias("r")
    return t.where("id IS NOT NULL").groupBy("id").agg(best).select("id", *[f"r.{c}" for c in PARTY[1:]])


def open_domains(records: DataFrame) -> frozenset[str]:
    """Domains of mail providers; at most 1 / OPEN_SHARE domains can pass the share, so the list is bounded.

    A domain is a provider's if the firms beside it are many: the most frequent firm word is too rare to be the owner's.
    """
    @F.pandas_udf("string")
    def domain(raw: pd.Series) -> pd.Series:
        return raw.map(lambda e: parts_of_email("x@" + e)[1] if e else None)

    @F.pandas_udf("string")
    def word(name: pd.Series, company: pd.Series) -> pd.Series:
        return pd.Series([firm_word(n, c) for n, c in zip(name, company)], dtype="object")

    raw = F.lower(F.regexp_replace(F.element_at(F.split("email", "@"), -1), r"[^A-Za-z0-9._\-]", ""))
    mailed = records.where(F.col("email").contains("@")).select(raw.alias("raw"), "name", "company")
    counts = mailed.groupBy("raw").agg(F.count("*").alias("n"))
    total = records.count()
    # Spellings of a domain differ by layout alone, so a frequent domain has a frequent spelling or many rare ones of its stem.
    named = counts.select("raw", domain("raw").alias("domain"), "n")
    many = named.groupBy("domain").agg(F.sum("n").alias("n")).where(F.col("n") > OPEN_SHARE * total).select("domain")
    frequent = sorted(r["domain"] for r in many.collect() if r["domain"])
    if not frequent:
        return frozenset()
    spelt = named.where(F.col("domain").isin(*frequent)).select("raw", "domain")
    beside = mailed.join(spelt, "raw").groupBy("domain", "name", "company").agg(F.count("*").alias("n"))
    beside = beside.select("domain", word("name", "company").alias("word"), "n").where("word IS NOT NULL").groupBy("domain", "word").agg(F.sum("n").alias("n"))
    rows, best = F.sum("n"), F.max("n")
    provider = (OWN * rows - best > DOUBT * F.sqrt(OWN * (1 - OWN) * rows)).alias("provider")
    return frozenset(r["domain"] for r in beside.groupBy("domain").agg(provider).where("provider").collect())


def firm_word(name: str | None, company: str | None) -> str | None:
    """The first word that tells the company, or the firm that is the party itself, from others."""
    from goldenloom.llm.name_variants import is_firm, key_words
    from goldenloom.llm.naming import Name

    for text in (company, name):
        if text and (n := Name(text)).bare and is_firm(n) and (words := key_words(n)):
            return words[0]
    return None
