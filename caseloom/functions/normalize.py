"""Term normalisation as column expressions; only unresolved distinct terms meet Python.

Dictionaries are literal maps, so a term is looked up without a join.  What
neither dictionaries nor tokens resolve is made distinct and compared with the
vocabulary by a Pandas UDF (difflib's similarity has no built-in counterpart),
then joined back.
"""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from caseloom.functions import vocab as V


def _squeeze(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def _plain(x: Column) -> Column:
    return _squeeze(F.regexp_replace(x, V.PUNCTUATION, " "))


def _tokens(x: Column) -> Column:
    return F.filter(F.split(x, " "), lambda t: t != "")


def _mapping(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def _found(term: Column, pairs: dict[str, str], names: list[str]) -> Column:
    """The preferred term of a known term, else null."""
    return F.try_element_at(_mapping({**{n: n for n in names}, **pairs}), term)


def clean_text(text: Column, strip_severity: bool = False) -> Column:
    """Lower case, punctuation to spaces, single spaces; on request without severity words."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return _plain(F.regexp_replace(low, V.SEVERITY, " ") if strip_severity else low)


def clean_drug_text(text: Column) -> Column:
    """A drug name's ingredient words; what would leave nothing is only cleaned."""
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.filter(_tokens(_plain(F.regexp_replace(low, V.DOSE, " "))), lambda t: ~t.isin(V.FORMS))
    rest = F.filter(F.slice(words, 2, 100_000), lambda t: ~t.isin(V.CATIONS + V.ANIONS))
    kept = F.when(words[0].isin(V.LEADS), words).otherwise(F.concat(F.slice(words, 1, 1), rest))
    return F.when(F.size(words) == 0, _plain(low)).otherwise(F.array_join(kept, " "))


def known_drug(full: Column, cleaned: Column) -> Column:
    """The ingredient by the whole name, else by the first known word; null if neither is known."""
    by_word = F.filter(F.transform(_tokens(full), lambda t: _found(t, V.BRANDS, V.DRUGS)), lambda t: t.isNotNull())
    return F.coalesce(_found(cleaned, V.BRANDS, V.DRUGS), F.try_element_at(by_word, F.lit(1)))


def known_event(raw: Column) -> Column:
    """The preferred term by whole text, without severity, by phrase, or by word; null if none is known."""
    text, base, bare = _squeeze(F.lower(raw)), clean_text(raw), clean_text(raw, True)
    phrases = [F.when(base.rlike(p) | text.rlike(p), F.lit(term)) for words, term in V.SYNONYMS.items() for p in [rf"(?U)(?<!\w){_quoted(words)}(?!\w)"]]
    by_word = F.filter(F.transform(_tokens(base), lambda t: _found(t, V.SYNONYMS, V.EVENTS)), lambda t: t.isNotNull())
    whole = F.coalesce(_found(text, V.SYNONYMS, V.EVENTS), _found(base, V.SYNONYMS, V.EVENTS), _found(bare, V.SYNONYMS, V.EVENTS))
    return F.coalesce(whole, *phrases, F.try_element_at(by_word, F.lit(1)))


def _quoted(words: str) -> str:
    return re.sub(r"([^A-Za-z0-9 ])", r"\\\1", words)


def nearest(term: str, names: list[str], cutoff: float) -> str | None:
    """The most similar name, if it can be a misspelling: same first letter, at most two letters longer or shorter."""
    best = difflib.get_close_matches(term, names, n=1, cutoff=cutoff) if term else []
    return best[0] if best and best[0][0] == term[0] and abs(len(best[0]) - len(term)) <= 2 else None


@F.pandas_udf(StringType())
def _near_drug(terms: pd.Series) -> pd.Series:
    def one(term: str) -> str:
        tries = (nearest(t, V.DRUGS, V.DRUG_CUTOFF) for t in [term, *term.split()])
        return next((t for t in tries if t), term)

    return terms.map(one)


@F.pandas_udf(StringType())
def _near_event(terms: pd.Series) -> pd.Series:
    return terms.map(lambda t: nearest(t, V.EVENTS, V.EVENT_CUTOFF) or t)


def normalized_terms(terms: DataFrame, kind: str, column: str = "raw") -> DataFrame:
    """(raw, norm) for each distinct raw term; norm is empty for terms without words."""
    raw = F.col("raw")
    distinct = terms.select(F.col(column).cast("string").alias("raw")).where("raw is not null").distinct()
    if kind == "drug":
        full, head = clean_drug_text(raw), clean_drug_text(F.substring_index(raw, "(", 1))
        staged = distinct.withColumn("full", full).withColumn("rest", F.when(head != "", head).otherwise(full))
        staged = staged.withColumn("known", F.when(F.col("full") == "", F.lit("")).otherwise(known_drug(F.col("full"), F.col("rest"))))
        near = _near_drug
    elif kind == "event":
        staged = distinct.withColumn("rest", clean_text(raw)).withColumn("known", F.coalesce(known_event(raw), F.when(F.col("rest") == "", F.lit(""))))
        near = _near_event
    else:
        raise ValueError("kind is drug or event")
    done = staged.where("known is not null").select("raw", F.col("known").alias("norm"))
    open_terms = staged.where("known is null").select("raw", "rest")
    guessed = open_terms.select("rest").distinct().withColumn("norm", near("rest"))
    return done.unionByName(open_terms.join(guessed, "rest").select("raw", "norm"))


def normalized_sets(rows: DataFrame, key: str, column: str, kind: str) -> DataFrame:
    """(key, column): each row's distinct sorted normalised terms, without empty ones; rows without terms are absent."""
    each = rows.select(F.col(key).alias("key"), F.explode(column).alias("raw"))
    joined = each.join(normalized_terms(each, kind), "raw").where("norm <> ''")
    return joined.groupBy("key").agg(F.array_sort(F.collect_set("norm")).alias(column)).withColumnRenamed("key", key)
