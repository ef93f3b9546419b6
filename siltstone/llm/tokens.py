"""Tokens of texts under a public tokenizer: exact counts, and estimates by regression for token budgets.

The budget tokenizes only a bounded sample of about SAMPLE texts of each language, picked by hash. Half of it fits one
least-squares regression for each language from bytes, words, digits, punctuation and scripts to tokens; a quarter is held out
and gives the factor that corrects the regression's bias; the last quarter had a part in neither, and gives the error that is
reported. The regression is applied to every text; languages with no sample use the regression of all languages together.

Defined results: null and empty texts have zero tokens; a null source or domain is a slice of its own. The language is the one
that the whole text's Han characters and function words tell clearly; a stated code stays where they tell nothing clear. Where
the code is unusable or missing, or says Chinese of a text without Han characters or the reverse, a weaker verdict is enough
('und' if there is neither verdict nor code).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokenizer import TOKENIZER, encoding
from ..session import stage
from .defects import FUNCTION_WORDS
from .quality import COMMA, DIGIT, HAN, LOWER, MARK, NEWLINE, SPACE, STOP, SYMBOL, TAB, UPPER, classes
from .text import runs_of

LANGUAGES = ("en", "de", "fr", "es", "zh")
SAMPLE = 2000
#: Least votes of a verdict, and how many times the runner-up's: clear ones override a stated code.
CLEAR, WEAK = (3, 2.0), (2, 1.4)
RIDGE = 1e-3
FEATURES = ("bytes", "words", "digits", "punctuation", "symbols", "han", "accented", "upper", "breaks")

_HAN = re.compile("[\u4e00-\u9fff]")


def count_tokens(texts: list[str | None], path: str = TOKENIZER) -> list[int]:
    return [len(x) for x in encoding(path).encode_ordinary_batch([t or "" for t in texts], num_threads=1)]


def clean_language(c: Column) -> Column:
    """Two-letter code of known languages, else null."""
    code = F.lower(F.substring(F.trim(c), 1, 2))
    return F.when(F.lower(F.trim(c)).rlike("^[a-z]{2}([-_].*)?$") & code.isin(*LANGUAGES), code)


def told_language(lang: str | None, text: str) -> str:
    """The language that the whole text tells, else the stated one; two Han characters count as one function word."""
    words = runs_of(text.lower())
    han = len(_HAN.findall(text))
    votes = [((han + 1) // 2, "zh"), *((sum(map(known.__contains__, words)), code) for code, known in FUNCTION_WORDS.items())]
    (n, code), (m, _) = sorted(votes, reverse=True)[:2]
    if n >= CLEAR[0] and n >= CLEAR[1] * m:
        return code
    if lang is None or (lang == "zh") != (han > 0):
        if n >= WEAK[0] and n >= WEAK[1] * m or code == "zh" and n > m == 0:
            return code
    return lang or "und"


def features_of(texts: list[str]) -> np.ndarray:
    size = np.array([len(t) + 1 for t in texts])
    flat = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    cls = classes()[np.minimum(flat, 0xFFFF)]
    starts = np.cumsum(size) - size
    letter = (cls == LOWER) | (cls == UPPER)
    word = letter & ~np.concatenate([[False], letter[:-1]])
    weight = 1 + (flat > 0x7F) + (flat > 0x7FF) + (flat > 0xFFFF)
    masks = (weight, word, cls == DIGIT, (cls == STOP) | (cls == COMMA) | (cls == MARK), cls >= SYMBOL, cls == HAN, letter & (flat > 0x7F), cls == UPPER, (cls == NEWLINE) | (cls == TAB))
    return np.stack([np.add.reduceat(m, starts, dtype=np.int64) for m in masks], axis=1) - np.array([1, 0, 0, 0, 0, 0, 0, 0, 1])


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for at in range(0, len(pdf), 200):
            part = pdf.iloc[at : at + 200]
            texts = [t or "" for t in part["text"]]
            told = [told_language(lang if isinstance(lang, str) else None, t) for lang, t in zip(part["lang"], texts)]
            frame = pd.DataFrame(features_of(texts), columns=list(FEATURES))
            yield frame.assign(corpus=part["corpus"].to_numpy(), key=part["key"].to_numpy(), source=part["source"].to_numpy(), domain=part["domain"].to_numpy(), lang=told)


def _tokenized(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"corpus": pdf["corpus"], "key": pdf["key"], "tokens": count_tokens(list(pdf["text"]), path)})

    return run


def fit(sample: pd.DataFrame) -> dict[str, tuple[np.ndarray, float, float]]:
    """For each language ('*': all) its coefficients, the bias factor and the median error on texts that neither has seen."""
    found = {}
    for lang, part in [("*", sample), *sample.groupby("lang")]:
        train, held, unseen = part[part["quarter"] < 2], part[part["quarter"] == 2], part[part["quarter"] == 3]
        if len(train) < 3 * len(FEATURES) or not len(held) or not len(unseen):
            continue
        x, y = train[list(FEATURES)].to_numpy(float), train["tokens"].to_numpy(float)
        scale = np.maximum(x.std(0), 1.0)
        a = np.vstack([x / scale, np.sqrt(RIDGE * len(x)) * np.eye(len(FEATURES))])
        coefficients = np.linalg.lstsq(a, np.concatenate([y, np.zeros(len(FEATURES))]), rcond=None)[0] / scale
        guess = [np.maximum(p[list(FEATURES)].to_numpy(float) @ coefficients, 0) for p in (held, unseen)]
        factor = held["tokens"].sum() / guess[0].sum() if guess[0].sum() else 1.0
        truth = unseen["tokens"].to_numpy(float)
        error = float(np.median(np.abs(guess[1] * factor - truth) / np.maximum(truth, 1)))
        found[lang] = (coefficients, factor, error)
    return found


def corpus_texts(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(corpus, key, source, lang, domain, text) of documents and of distinct chunks."""
    docs = documents.select(F.lit("documents").alias("corpus"), F.col("doc_id").cast("string").alias("key"), "source", clean_language(F.col("lang")).alias("lang"), "domain", "text")
    parts = chunks.filter("chunk_id is not null").groupBy("chunk_id").agg(F.min(F.struct("source", "text", F.col("metadata")["lang"].alias("lang"), F.col("metadata")["domain"].alias("domain"))).alias("r"))
    parts = parts.select(F.lit("text_chunks").alias("corpus"), F.col("chunk_id").alias("key"), "r.source", clean_language(F.col("r.lang")).alias("lang"), "r.domain", "r.text")
    return docs.unionByName(parts)


def estimated_tokens(documents: DataFrame, chunks: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """Every text with its language and estimated tokens."""
    texts = corpus_texts(documents, chunks)
    schema = ", ".join(f"{f} long" for f in FEATURES) + ", corpus string, key string, source string, domain string, lang string"
    rows = stage(texts.mapInPandas(_features, schema), "features")
    share = F.pmod(F.xxhash64("corpus", "key"), F.lit(1_000_003)) / 1_000_003.0
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = F.lit(0.0)
    for lang, n in counts.items():
        rate = F.when(F.col("lang") == lang, SAMPLE / n).otherwise(rate)
    name = F.xxhash64("corpus", "key")
    picked = stage(rows.filter(share < rate).withColumn("quarter", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(4)).cast("int")), "sample")
    chosen = F.broadcast(picked.select(name.alias("name")))  # about SAMPLE rows a language
    tokenized = texts.join(chosen, name == F.col("name"), "left_semi").select("corpus", "key", "text").mapInPandas(_tokenized(path), "corpus string, key string, tokens long")
    model = fit(picked.join(tokenized, ["corpus", "key"]).drop("source", "domain").orderBy("corpus", "key").toPandas())
    tokens = F.col("bytes") / 4.0
    for lang, (coefficients, factor, _) in model.items():
        guess = F.greatest(F.lit(0.0), sum((F.col(f) * float(c) for f, c in zip(FEATURES, coefficients)), F.lit(0.0))) * float(factor)
        tokens = guess if lang == "*" else F.when(F.col("lang") == lang, guess).otherwise(tokens)
    errors = F.create_map(*[F.lit(x) for lang, (_, _, e) in model.items() for x in (lang, e)]) if model else F.create_map().cast("map<string,double>")
    return rows.select("corpus", "key", "source", "lang", "domain", F.when(F.col("bytes") > 0, tokens).otherwise(0.0).alias("tokens"), F.coalesce(F.try_element_at(errors, F.col("lang")), F.try_element_at(errors, F.lit("*"))).alias("held_out_error"))


def token_budget(documents: DataFrame, chunks: DataFrame, stats: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """Texts and estimated tokens by corpus, source, language and domain, beside the source's total and its reported one."""
    slices = estimated_tokens(documents, chunks, path).groupBy("corpus", "source", "lang", "domain").agg(F.count(F.lit(1)).alias("texts"), F.round(F.sum("tokens")).cast("long").alias("estimated_tokens"), F.round(F.avg("held_out_error"), 4).alias("median_held_out_error"))
    slices = stage(slices, "slices")
    totals = slices.groupBy("corpus", "source").agg(F.sum("estimated_tokens").alias("source_tokens"))
    reported = stats.groupBy("source").agg(F.max_by("source_estimated_tokens", F.when(F.col("source_estimated_tokens").isNotNull(), F.col("run_id"))).alias("reported_tokens")).withColumn("corpus", F.lit("documents"))
    found = slices.alias("s").join(totals.alias("t"), F.col("s.corpus").eqNullSafe(F.col("t.corpus")) & F.col("s.source").eqNullSafe(F.col("t.source"))).select("s.*", "t.source_tokens")
    return found.join(reported, ["corpus", "source"], "left")
