"""Statistics of each document's text, and from them whether it is prose, list, table or junk.

`document_statistics` counts words, symbols and lines, a batch of whole texts at once over arrays of code points. A Gaussian
mixture is fitted to the standardised statistics of all documents by expectation-maximization: every step is one pass over
the staged statistics, and only sums of the model's own size reach the driver. Steps end when the mean log likelihood of a
document rises by less than TOLERANCE, or after STEPS. Components start at the inspected examples of
`examples.py`, and after the last step each takes the kind of the examples it answers for. A document's kind is the one with
the greatest posterior over all components.

Defined results: a null, empty or blank text has zero counts and is junk, since nothing in it can be read. Statistics cover
whole texts; equal texts get equal kinds; on an empty table the result is empty.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .examples import EXAMPLES

KINDS = ("prose", "list", "table", "junk")
STEPS = 40
TOLERANCE = 0.02
RIDGE = 0.02
PRIOR = 50.0
BATCH = 100
USUAL_VOWELS = 0.38
#: Frequent function words of English, German, French and Spanish, and frequent Chinese characters.
COMMON_WORDS = frozenset("the of and a to in is was that for it with as on be at by from had has are were this an no after before not which even will must does until because when if there been their its der die das und ist zu den von mit nicht ein eine im auf dem des bei hat wird nach wenn nur le la les de et est une un du dans pour que qui sur au par pas avec ou il en el los las y se con del por para una al es ha si su fue lo".split())
COMMON_HAN = "的一是在不了有和人这中大为上个我以要他时来用们到说于由需内即进行发现出根据应每次查"

COUNTS = ("n_chars", "n_words", "n_lines")
STATS = ("mean_word", "common_share", "symbol_share", "digit_share", "letter_share", "end_share", "running_share", "entry_share", "cell_share", "noise_share", "words_a_line", "words_a_mark", "log_distinct", "vowel_share")
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", " + ", ".join(f"{c} double" for c in STATS)

SPACE, NEWLINE, LOWER, UPPER, DIGIT, STOP, COMMA, MARK, BAR, SYMBOL, HAN, ODD, TAB = range(13)
_RULE = re.compile(r"^[\s|+:=_-]{3,}$", re.M)


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point of the basic plane; above it only letters and symbols are told apart."""
    table = np.full(0x10000, SYMBOL, np.uint8)
    for c in range(0x10000):
        kind = unicodedata.category(chr(c))
        if kind in ("Lu", "Lt"):
            table[c] = UPPER
        elif kind[0] in "LM":
            table[c] = HAN if 0x2E80 <= c <= 0x9FFF or 0xAC00 <= c <= 0xD7A3 else LOWER
        elif kind[0] == "N":
            table[c] = DIGIT
        elif kind[0] == "Z":
            table[c] = SPACE
        elif kind == "Cc" or kind == "Co":
            table[c] = ODD
    groups = {SPACE: " \r\u200b\ufeff", NEWLINE: "\n\x0b\x0c\x85\u2028\u2029", TAB: "\t", STOP: ".!?…。！？", COMMA: ",;、，；", MARK: "'\"()-–—“”‘’«»„°%/:：（）《》¿¡[]*•·µ²³", BAR: "|", ODD: "\ufffd§¶¤™€ŸœðÃÂâ¢"}
    for group, chars in groups.items():
        for c in chars:
            table[ord(c)] = group
    return table


@lru_cache(1)
def _common_han() -> np.ndarray:
    table = np.zeros(0x10000, bool)
    table[[ord(c) for c in COMMON_HAN]] = True
    return table


@lru_cache(1)
def _vowels() -> np.ndarray:
    return np.array([unicodedata.normalize("NFD", chr(c))[0].lower() in "aeiouyæœøαεηιουωаеёиоуыэюя" for c in range(0x10000)])


def batch_statistics(texts: list[str | None]) -> pd.DataFrame:
    """The statistics of a batch of texts, in order."""
    clean = [_RULE.sub("", t or "") for t in texts]
    size = np.array([len(t) + 1 for t in clean])
    flat = np.frombuffer("".join(t + "\n" for t in clean).encode("utf-32-le", "surrogatepass"), np.uint32)
    cls = classes()[np.minimum(flat, 0xFFFF)]
    cls[flat > 0xFFFF] = np.where((flat[flat > 0xFFFF] >= 0x20000) & (flat[flat > 0xFFFF] < 0x32000), HAN, SYMBOL)
    doc = np.repeat(np.arange(len(clean)), size)
    before, after = np.concatenate([[NEWLINE], cls[:-1]]), np.concatenate([cls[1:], [NEWLINE]])
    blank = (cls == SPACE) | (cls == NEWLINE) | (cls == TAB)
    blank_before, blank_after = np.concatenate([[True], blank[:-1]]), np.concatenate([blank[1:], [True]])
    letter = (cls == LOWER) | (cls == UPPER)
    letter_before = np.concatenate([[False], letter[:-1]])
    line = np.cumsum(before == NEWLINE) - 1
    lines = line[-1] + 1
    starts = np.flatnonzero(before == NEWLINE)
    column = np.arange(len(cls)) - starts[line]

    def a_line(mask):
        return np.add.reduceat(mask, starts, dtype=np.int32).astype(float)

    word = letter & ~letter_before
    words, han = a_line(word), a_line(cls == HAN)
    wordy = np.concatenate([[0], np.cumsum(~blank & (cls != DIGIT) & (cls != STOP))])
    numbering = (cls == STOP) & (before == DIGIT) & (wordy[:-1] == wordy[starts][line])
    stop = (cls == STOP) & (blank_after | (after == HAN) | (after == MARK)) & ~blank_before & ~numbering
    stops, commas = a_line(stop), a_line(cls == COMMA)
    tight = a_line((cls == COMMA) & ~blank_after & ~(flat == ord("，")) & ~(flat == ord("、")))
    solid = a_line(~blank)
    seen = solid > 0
    gap = a_line((cls == SPACE) & (before == SPACE) & ~blank_after & (column > 2) & (np.concatenate([[0, 0], column[:-2]]) >= 0))
    lead = a_line((cls == SPACE) & (before == SPACE) & ~blank_after & (np.concatenate([[0], np.cumsum(~blank)[:-1]]) - np.concatenate([[0], np.cumsum(~blank)])[starts[line]] == 0))
    gap = np.maximum(gap - lead, 0)
    bars, tabs = a_line(cls == BAR), a_line(cls == TAB)
    symbols, odd, digits = a_line(cls == SYMBOL), a_line(cls == ODD), a_line(cls == DIGIT)
    token = ~blank & blank_before
    tokens = a_line(token)
    token_starts = np.flatnonzero(token)
    token_id = np.cumsum(token) - 1
    lengths = np.bincount(token_id[~blank], minlength=len(token_starts))
    piece = ~blank & (cls != COMMA) & (cls != BAR)
    piece_starts = np.flatnonzero(piece & ~np.concatenate([[False], piece[:-1]]))
    piece_id = np.cumsum(piece & ~np.concatenate([[False], piece[:-1]])) - 1
    sizes, hans = np.bincount(piece_id[piece], minlength=len(piece_starts)), np.bincount(piece_id[cls == HAN], minlength=len(piece_starts))
    long = np.bincount(line[piece_starts], (sizes > 28) & (hans == 0), minlength=lines)
    pairs = np.bincount(line[token_starts], lengths == 2, minlength=lines)
    ends = np.zeros(lines, bool)
    last = np.maximum.reduceat(np.where(blank, -1, np.arange(len(cls))), starts)
    ends[seen] = (cls[last[seen]] == STOP) | ((cls[last[seen]] == MARK) & (cls[np.maximum(last[seen] - 1, 0)] == STOP))
    first = np.minimum.reduceat(np.where(blank, len(cls), np.arange(len(cls))), starts)
    first_class = np.full(lines, SPACE)
    first_class[seen] = cls[first[seen]]
    marked = seen & ((first_class == MARK) | (first_class == DIGIT) & (a_line(letter & (column <= 2)) == 0))

    running = words + han / 2
    noise = seen & ((long > 0) | (odd > 0.12 * solid) | (symbols > 0.22 * solid) | (pairs > 0.7 * tokens) & (tokens > 6))
    spread = (bars >= 2) | (tabs >= 1) | (gap >= 1) & (stops < 1) | (tight >= 2) & (tight > 0.6 * commas) & (stops < 2)
    cell = seen & ~noise & spread
    listed = (commas >= 4) & (running / (commas + 1) < 4.6) & (stops <= 1) & ~(han > 0.6 * solid)
    short = (running <= 7) & (solid <= 38) & ((stops - (ends & marked)) < 1) | marked & (running <= 10) & (stops - ends < 1)
    entry = seen & ~noise & ~cell & (listed | short)
    text = seen & ~noise & ~cell & ~entry

    home = doc[starts]

    def a_doc(values):
        return np.bincount(home, values, minlength=len(clean)).astype(float)

    total = np.maximum(a_doc(solid), 1)
    n_lines, n_words, letters = a_doc(seen), a_doc(words), a_doc(a_line(letter))
    all_han = a_doc(han)
    parts = [t.lower().split() for t in clean]
    common = np.array([sum(map(COMMON_WORDS.__contains__, p)) for p in parts], float)
    distinct = np.log([min(1.0, max(1, len(set(p))) / max(1, min(len(p), 40))) for p in parts])
    common += 2 * np.bincount(doc[_common_han()[np.minimum(flat, 0xFFFF)]], minlength=len(clean))
    count = n_words + all_han
    marks = a_doc(commas) + a_doc(stops) + 1
    wide = a_doc(running)
    return pd.DataFrame({
        "n_chars": [len(t or "") for t in texts], "n_words": count.astype(int), "n_lines": n_lines.astype(int),
        "mean_word": (letters + 2 * all_han) / np.maximum(count, 1), "common_share": np.minimum(1, common / np.maximum(count, 1)),
        "symbol_share": (a_doc(symbols) + a_doc(odd) + a_doc(bars)) / total, "digit_share": a_doc(digits) / total, "letter_share": (letters + all_han) / total,
        "end_share": a_doc(ends) / np.maximum(n_lines, 1), "running_share": a_doc(solid * text) / total, "entry_share": a_doc(solid * entry) / total,
        "cell_share": a_doc(solid * cell) / total, "noise_share": a_doc(solid * noise) / total,
        "words_a_line": np.log1p(wide / np.maximum(n_lines, 1)), "words_a_mark": np.log1p(wide / marks), "log_distinct": distinct,
        "vowel_share": np.where(letters < 12, USUAL_VOWELS, a_doc(a_line(_vowels()[np.minimum(flat, 0xFFFF)] & letter)) / np.maximum(letters, 1)),
    })


def _statistics(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for at in range(0, len(pdf), BATCH):
            part = pdf.iloc[at : at + BATCH]
            yield batch_statistics([None if x is None else str(x) for x in part["text"]]).assign(doc_id=part["doc_id"].to_numpy())[["doc_id", *COUNTS, *STATS]]


def document_statistics(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", "text").mapInPandas(_statistics, SCHEMA)


def _standard(frame: pd.DataFrame, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return (frame[list(STATS)].to_numpy(float) - mean) / scale


def _start(x: np.ndarray, shapes: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One component for each shape of the examples."""
    names = sorted(set(shapes))
    means = np.stack([x[[s == n for s in shapes]].mean(0) for n in names])
    return np.full(len(names), 1 / len(names)), means, np.stack([np.eye(x.shape[1]) * 0.5] * len(names))


def log_densities(x: np.ndarray, weights: np.ndarray, means: np.ndarray, covariances: np.ndarray) -> np.ndarray:
    """Log of each component's weight times its density, but for a constant."""
    logs = np.empty((len(x), len(weights)))
    for k, (w, m, c) in enumerate(zip(weights, means, covariances)):
        root = np.linalg.inv(np.linalg.cholesky(c))
        z = (x - m) @ root.T
        logs[:, k] = np.log(w) + np.log(np.diag(root)).sum() - 0.5 * np.einsum("ij,ij->i", z, z)
    return logs


def posteriors(x: np.ndarray, *model: np.ndarray) -> np.ndarray:
    return _shares(log_densities(x, *model))[0]


def _shares(logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors, and the log likelihood of each row."""
    top = logs.max(1, keepdims=True)
    p = np.exp(logs - top)
    total = p.sum(1, keepdims=True)
    return p / total, (top + np.log(total))[:, 0]


def _sums(model: tuple, mean: np.ndarray, scale: np.ndarray):
    """For each component the sums of an expectation step over one partition; as component -1 the log likelihood."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, likelihood = None, 0.0
        for pdf in batches:
            x = _standard(pdf, mean, scale)
            p, logs = _shares(log_densities(x, *model))
            likelihood += logs.sum()
            squares = np.stack([((x * q[:, None]).T @ x).ravel() for q in p.T])
            part = np.concatenate([p.sum(0)[:, None], p.T @ x, squares], axis=1)
            total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"component": [-1], "at": [0], "value": [likelihood]})
            for k, row in enumerate(total):
                yield pd.DataFrame({"component": k, "at": np.arange(len(row)), "value": row})

    return run


def _improved(rows: list, shape: tuple[int, int], start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A maximization step; PRIOR documents' weight holds a component near its examples where it answers for few texts."""
    k, d = shape
    total = np.zeros((k, 1 + d + d * d))
    for r in rows:
        if r["component"] >= 0:
            total[r["component"], r["at"]] = r["value"]
    n = total[:, 0]
    means = (total[:, 1 : 1 + d] + PRIOR * start) / (n + PRIOR)[:, None]
    second = total[:, 1 + d :].reshape(k, d, d)
    first = total[:, 1 : 1 + d]
    spread = second - means[:, :, None] * first[:, None, :] - first[:, :, None] * means[:, None, :] + n[:, None, None] * means[:, :, None] * means[:, None, :]
    covariances = (spread + PRIOR * 0.25 * np.eye(d)) / (n + PRIOR)[:, None, None] + RIDGE * np.eye(d)
    return (n + 1) / (n + 1).sum(), means, covariances


def fit_mixture(stats: DataFrame) -> tuple[tuple, np.ndarray, np.ndarray, list[float]]:
    """The fitted model, the mean and scale that statistics are standardised by, and the mean log likelihood at each step."""
    seen = stats.filter("n_lines > 0")
    moments = seen.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m_{c}") for c in STATS], *[F.stddev_pop(c).alias(f"s_{c}") for c in STATS]).first()
    mean = np.array([moments[f"m_{c}"] or 0.0 for c in STATS])
    scale = np.array([max(moments[f"s_{c}"] or 0.0, 0.05) for c in STATS])
    x = _standard(batch_statistics([text for _, _, text in EXAMPLES]), mean, scale)
    model, history = _start(x, [f"{kind} {shape}" for kind, shape, _ in EXAMPLES]), []
    start = model[1]
    seen = seen.select(*STATS)
    for _ in range(STEPS):
        rows = seen.mapInPandas(_sums(model, mean, scale), "component int, at int, value double").groupBy("component", "at").agg(F.sum("value").alias("value")).collect()
        history.append(sum(r["value"] for r in rows if r["component"] < 0) / max(1, moments["n"]))
        if len(history) > 1 and history[-1] - history[-2] < TOLERANCE:
            break
        model = _improved(rows, start.shape, start)
    return model, mean, scale, history


def document_kinds(documents: DataFrame) -> DataFrame:
    """The statistics of each document, with its kind and the posterior of that kind."""
    stats = stage(document_statistics(documents), "statistics")
    model, mean, scale, _ = fit_mixture(stats)
    x, kinds = _standard(batch_statistics([text for _, _, text in EXAMPLES]), mean, scale), np.array([KINDS.index(kind) for kind, _, _ in EXAMPLES])
    p = posteriors(x, *model)
    votes = np.stack([p[kinds == k].sum(0) for k in range(len(KINDS))])
    kind_of = votes.argmax(0)

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            q = posteriors(_standard(pdf, mean, scale), *model)
            by_kind = np.stack([q[:, kind_of == k].sum(1) for k in range(len(KINDS))], axis=1)
            best = np.where(pdf["n_lines"].to_numpy() > 0, by_kind.argmax(1), KINDS.index("junk"))
            yield pdf.assign(kind=np.array(KINDS, dtype=object)[best], posterior=by_kind[np.arange(len(pdf)), best])

    return stats.mapInPandas(decide, SCHEMA + ", kind string, posterior double")
