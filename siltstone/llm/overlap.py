"""Same or near-same records across splits: an exact prefix-filter join of evaluation texts against training texts.

Two texts are near-same when fewer than one word in five of the longer one differs (edits of words, in order). d edits leave
at least one of any d + 1 disjoint shingles of the evaluation text whole, so the d + 1 disjoint shingles that are rarest in
the training texts are a complete prefix: they are indexed, every shingle of the training texts probes them under a length
and a position filter, and what meets is verified by edit distance. No candidate is dropped: the choice of shingles (a
dynamic programme over estimated frequencies, or in long texts the rarest of each of d + 1 parts) changes only how many
candidates there are.

An index of at most INDEX_IN_TASKS rows is sent to the executors, and training texts probe it inside the Arrow batch. A
larger one stays a table: training shingles that it can't hold are left out by a Bloom filter of at most 2 ** MOST_BITS bits,
and the rest are joined to it. A fuller filter lets more shingles pass to the join, never fewer; both ways give the same pairs.

Equal texts are one text on either side, a class, while candidates are sought, so a group of copies costs nothing: links
are between classes, and copies are expanded only where a result names pairs of rows. Null and wordless texts pair with
nothing. A row whose split is null or neither val, train nor pretrain takes no part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .text import MARKER, runs_of, word_distance, word_hashes

LENGTHS = (2, 4, 8)
SIGNATURE_LONGS = 8
FEWEST_WORDS = 5
INDEX_IN_TASKS = 2_000_000
BAND = 1.25
LONG_WORDS = 400
TEXTS_AT_ONCE, PROBED_AT_ONCE = 64, 5000
LEAST_BITS, MOST_BITS = 15, 28
BITMAP_BITS = 32768
MIX = np.uint64(0x9E3779B97F4A7C15)
_MARKER = re.compile(MARKER)
MARKS = [f"s{i}" for i in range(SIGNATURE_LONGS)]


def allowed(longer):
    """The most edits d with d < longer / 5."""
    return -(-longer // 5) - 1


def _shingles(h: np.ndarray) -> dict[int, np.ndarray]:
    """Hash of the shingle of each length that starts at each word, by doubling."""
    with np.errstate(over="ignore"):
        out, one, k = {}, h * MIX ^ (h >> np.uint64(29)), 1
        while k < max(LENGTHS):
            if len(one) <= k:
                break
            one = (one[:-k] * MIX + np.uint64(k)) ^ (one[k:] * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(7)) ^ (one[k:] << np.uint64(13))
            k *= 2
            out[k] = one
    return out


class Batch:
    """The words of a batch of texts in one row: their hashes, the text and the place of each, and the words left from there."""

    def __init__(self, texts: list[str]):
        flat = " ".join(texts).split(" ")
        self.n = np.array([t.count(" ") + 1 for t in texts], dtype=int)
        self.one = word_hashes(flat)
        self.text = np.repeat(np.arange(len(self.n)), self.n)
        self.at = np.arange(len(self.one)) - np.repeat(np.cumsum(self.n) - self.n, self.n)
        self.left = self.n[self.text] - self.at

    def shingles(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Length, places and hashes of the shingles that lie within one text."""
        for k, h in _shingles(self.one).items():
            inside = np.flatnonzero(self.left[: len(h)] >= k)
            yield k, inside, h[inside]


def choose(cost: dict[int, np.ndarray], n: np.ndarray, text: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each request (text, count) as many disjoint shingles of that text, of least total cost: (request, start, length).

    cost[k] has a row for each text and a column for each start; starts without room for k words cost infinity.
    """
    width = int(n.max())
    best, moves, columns = np.zeros((len(n), width + 1)), [], np.arange(width + 1)
    for _ in range(int(count.max())):
        new, by = np.full((len(n), width + 1), np.inf), np.zeros((len(n), width + 1), np.int8)
        for k, c in cost.items():
            if c.shape[1]:
                t, seen = best[:, : c.shape[1]] + c, new[:, k : k + c.shape[1]]
                better = t < seen
                seen[better] = t[better]
                by[:, k : k + c.shape[1]][better] = k
        least = np.minimum.accumulate(new, axis=1)
        fresh = new < np.concatenate([np.full((len(n), 1), np.inf), least[:, :-1]], axis=1)
        moves.append((np.maximum.accumulate(np.where(fresh, columns, 0), axis=1), by))
        best = least
    end, out = n[text].copy(), []
    for step in range(len(moves) - 1, -1, -1):
        r = np.flatnonzero(count > step)
        till, by = moves[step]
        stop = till[text[r], end[r]]
        k = by[text[r], stop].astype(int)
        out.append((r, stop - k, k))
        end[r] = stop - k
    return tuple(np.concatenate(x) for x in zip(*out))


def rarest_of_parts(cost: dict[int, np.ndarray], n: int, count: int) -> list[tuple[int, int]]:
    """For one long text: the cheapest shingle of each of `count` equal parts, (start, length)."""
    cuts = np.arange(count + 1) * n // count
    out = []
    for s, e in zip(cuts, cuts[1:]):
        found = [(float(c[s : e - k + 1].min()), int(s + c[s : e - k + 1].argmin()), k) for k, c in cost.items() if e - s >= k]
        out.append(min(found)[1:])
    return out


def band_of(m):
    """Band of a text's length: partners of one band have lengths within a factor BAND."""
    return np.floor(np.log(m) / np.log(BAND) + 1e-9).astype(np.int64)


def _key(h: np.ndarray, band: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((h ^ band.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) * MIX).view(np.int64)


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How often each word and each pair of neighbours occurs in a batch of training texts."""
    for pdf in batches:
        if len(pdf):
            b = Batch(list(pdf["norm"]))
            for h in (b.one, next((h for k, _, h in b.shingles() if k == 2), np.zeros(0, np.uint64))):
                place, h = pd.factorize(h.view(np.int64))
                yield pd.DataFrame({"h": h, "n": np.bincount(place, minlength=len(h))})


def _places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The word and the pair of neighbours at each place of the evaluation texts."""
    for pdf in batches:
        if len(pdf):
            b = Batch(list(pdf["norm"]))
            two = np.append(_shingles(b.one)[2], np.uint64(0))
            two[b.left == 1] = 0
            yield pd.DataFrame({"key": pdf["key"].to_numpy()[b.text], "at": b.at, "h": b.one.view(np.int64), "h2": two.view(np.int64)})


def estimated(one: np.ndarray, two: np.ndarray, n: np.ndarray) -> dict[int, np.ndarray]:
    """Expected occurrences of each shingle, from those of its words and pairs of neighbours (a first-order chain)."""
    one, two = np.maximum(one, 0.3), np.maximum(two[:, :-1], 0.3)
    chain = np.concatenate([np.zeros((len(n), 1)), np.cumsum(np.log(np.minimum(two / one[:, :-1], 1.0)), axis=1)], axis=1)
    out, width = {}, one.shape[1]
    for k in LENGTHS:
        if width >= k:
            c = one[:, : width - k + 1] * np.exp(chain[:, k - 1 :] - chain[:, : width - k + 1]) + 1e-6
            out[k] = np.where(np.arange(width - k + 1) <= (n - k)[:, None], c, np.inf)
    return out


def _needs(n: int) -> list[tuple[int, int]]:
    """(band, shingles needed) for each band of the lengths that partners of a text of n words can have."""
    lengths = np.arange(n * 4 // 5 + 1, -(-5 * n // 4))
    bands = band_of(lengths)
    return [(int(b), int(allowed(max(n, lengths[bands == b][-1]))) + 1) for b in np.unique(bands)]


def _index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rare disjoint shingles of evaluation texts, a set for each band of the partner's length."""
    for pdf in batches:
        pdf = pdf.sort_values("n", ignore_index=True)
        for at in range(0, len(pdf), TEXTS_AT_ONCE):
            part = pdf.iloc[at : at + TEXTS_AT_ONCE]
            for group in ([part.iloc[[i]] for i in range(len(part))] if part["n"].max() > LONG_WORDS else [part]):
                yield _index_rows(group)


def _index_rows(part: pd.DataFrame) -> pd.DataFrame:
    n, b = part["n"].to_numpy(), Batch(list(part["norm"]))
    one, two = np.ones((len(n), n.max())), np.ones((len(n), n.max()))
    for i, (x, y) in enumerate(zip(part["one"], part["two"])):
        one[i, : n[i]], two[i, : n[i]] = x, y
    cost = estimated(one, two, n)
    needs = [(i, band, count) for i, size in enumerate(n) for band, count in _needs(int(size))]
    text, band, count = (np.array(x) for x in zip(*needs))
    if n.max() > LONG_WORDS:
        picked = [(r, s, k) for r, c in enumerate(count) for s, k in rarest_of_parts({k: v[0] for k, v in cost.items()}, int(n[0]), int(c))]
        request, start, length = (np.array(x) for x in zip(*picked))
    else:
        request, start, length = choose(cost, n, text, count)
    hashes, begin = _shingles(b.one), np.cumsum(n) - n
    place = begin[text[request]] + start
    h = np.zeros(len(request), np.uint64)
    for k in cost:
        h[length == k] = hashes[k][place[length == k]]
    return pd.DataFrame({"h": _key(h, band[request]), "key_a": part["key"].to_numpy()[text[request]], "at_a": start, "n": n[text[request]]})


def _filter_places(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The two places of a key in the Bloom filter."""
    u = keys.view(np.uint64)
    yield (u >> np.uint64(64 - bits)).view(np.int64)
    yield ((u >> np.uint64(7)) & np.uint64(2**bits - 1)).view(np.int64)


def _passing(keys: np.ndarray, known: np.ndarray, bits: int) -> np.ndarray:
    """Which keys the filter may hold."""
    at = np.arange(len(keys))
    for place in _filter_places(keys, bits):
        place = place[at]
        at = at[(known[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1]
    return at


def _filter_bits(keys: int) -> int:
    return int(np.clip(np.ceil(np.log2(max(1, 16 * keys))), LEAST_BITS, MOST_BITS))


def index_filter(index: DataFrame) -> tuple[np.ndarray, int]:
    """A Bloom filter of the index keys: bytes, and the number of address bits. At most 2 ** MOST_BITS bits reach the driver."""
    bits = _filter_bits(index.count())
    spots = F.array(F.shiftrightunsigned("h", 64 - bits), F.shiftrightunsigned("h", 7).bitwiseAND(F.lit(2**bits - 1)))
    rows = index.select(F.explode(spots).alias("p")).groupBy(F.floor(F.col("p") / BITMAP_BITS).alias("part")).agg(F.bitmap_construct_agg(F.col("p") % BITMAP_BITS).alias("bits")).collect()
    out = np.zeros(2**bits // 8, np.uint8)
    for r in rows:
        out[r["part"] * BITMAP_BITS // 8 : (r["part"] + 1) * BITMAP_BITS // 8] = np.frombuffer(r["bits"], np.uint8)
    return out, bits


def index_arrays(index: DataFrame, texts: DataFrame) -> dict[str, np.ndarray]:
    """The index and the signatures of its texts as arrays, for at most INDEX_IN_TASKS rows."""
    marks = texts.select("key", "n", *MARKS).toArrow().to_pandas()
    rows = index.select("h", "at_a", "key_a").toArrow().to_pandas()
    owner = pd.Index(marks["key"]).get_indexer(rows.pop("key_a")).astype(np.int32)
    return {"h": rows["h"].to_numpy(), "at_a": rows["at_a"].to_numpy(), "owner": owner, "keys": marks["key"].to_numpy(), "n": marks["n"].to_numpy(), "marks": marks[MARKS].to_numpy()}


def _probe(known: np.ndarray, bits: int):
    """The shingles of the training texts that the index may hold, with the signatures of their texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            b, key, marks = Batch(list(pdf["norm"])), pdf["key"].to_numpy(), pdf[MARKS].to_numpy()
            band = band_of(b.n)
            for _, at, h in b.shingles():
                h = _key(h, band[b.text[at]])
                hit = _passing(h, known, bits)
                at = at[hit]
                text = b.text[at]
                yield pd.DataFrame({"key_b": key[text], "m": b.n[text], "at_b": b.at[at], "h": h[hit], **{f"{s}_b": marks[text, i] for i, s in enumerate(MARKS)}})

    return run


def _probe_inside(index: dict[str, np.ndarray]):
    """(key_a, key_b) of the training texts that meet an index row and pass all filters."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # |shift| + |m - n - shift| <= most says that the places, as seen from the middles of their texts, lie within most / 2. The
        # rows of a key are sorted by twice that place, so that only those near enough are met.
        keys, rank = np.unique(index["h"], return_inverse=True)
        spots = (rank << 32) + 2 * index["at_a"].astype(np.int64) - index["n"][index["owner"]]
        order = np.argsort(spots)
        spots = spots[order]
        bits = _filter_bits(len(keys))
        marked = np.zeros(2**bits, bool)
        for place in _filter_places(keys, bits):
            marked[place] = True
        known = np.packbits(marked, bitorder="little")
        for pdf in (pdf.iloc[at : at + PROBED_AT_ONCE] for pdf in batches for at in range(0, len(pdf), PROBED_AT_ONCE)):
            b, key, marks = Batch(list(pdf["norm"])), pdf["key"].to_numpy(), pdf[MARKS].to_numpy()
            band, found = band_of(b.n), []
            for _, at, h in b.shingles():
                h = _key(h, band[b.text[at]])
                passing = _passing(h, known, bits)
                passing = passing[np.argsort(h[passing])]  # looked up in order, for the processor's caches
                at, h = at[passing], h[passing]
                spot = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[spot] == h
                at, spot = at[hit], spot[hit]
                m = b.n[b.text[at]]
                middle, reach = (spot << 32) + 2 * b.at[at] - m, allowed(-(-5 * m // 4))
                first = np.searchsorted(spots, middle - reach)
                many = np.searchsorted(spots, middle + reach, side="right") - first
                found_at = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                text, owner = np.repeat(b.text[at], many), index["owner"][order[found_at]]
                most = allowed(np.maximum(b.n[text], index["n"][owner]))
                near = (np.abs(np.repeat(middle, many) - spots[found_at]) <= most) & (np.abs(b.n[text] - index["n"][owner]) <= most)
                text, owner, most = text[near], owner[near], most[near]
                for half in (slice(0, SIGNATURE_LONGS // 4), slice(None)):  # what few bits of the signature rule out needs no more
                    differ = np.bitwise_count((index["marks"][owner, half] ^ marks[text, half]).view(np.uint64)).sum(1, dtype=np.int64)
                    text, owner, most = text[differ <= 2 * most], owner[differ <= 2 * most], most[differ <= 2 * most]
                found.append(np.stack([owner, text]))
            pairs = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), int)
            yield pd.DataFrame({"key_a": index["keys"][pairs[0]], "key_b": key[pairs[1]]})

    return run


def _normal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The text's words in one form, a name for it, and a bit for each distinct word's hash: one edit changes at most two bits."""
    for pdf in batches:
        norm = [" ".join(runs_of((_MARKER.sub(" ", t) if "<|" in t else t).lower())) for t in pdf["text"]]
        pdf = pdf.drop(columns="text").assign(norm=norm)
        pdf = pdf[pdf["norm"] != ""]
        if len(pdf):
            b = Batch(list(pdf["norm"]))
            bits = np.zeros((len(pdf), SIGNATURE_LONGS * 64), np.uint8)
            bits[b.text, (b.one % np.uint64(bits.shape[1])).astype(int)] = 1
            longs = np.packbits(bits, axis=1).view(np.int64)
            yield pdf.assign(text_id=[hashlib.md5(t.encode("utf-8", "replace")).hexdigest() for t in pdf["norm"]], n=b.n, **{s: longs[:, i] for i, s in enumerate(MARKS)})


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        pairs = [(a.split(" "), b.split(" ")) for a, b in zip(pdf["norm_a"], pdf["norm_b"])]
        most = np.array([allowed(max(len(a), len(b))) for a, b in pairs], dtype=int)
        edits = np.array([word_distance(a, b, int(k)) for (a, b), k in zip(pairs, most)], dtype=int)
        keep = edits <= most
        yield pd.DataFrame({"id_a": pdf["id_a"][keep], "id_b": pdf["id_b"][keep], "edits": edits[keep]})


def overlap_links(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members (side, text_id, row_id, corpus, source, split) of the classes of equal texts, side a of val rows and b of
    training rows, and the links (id_a, id_b, edits) between classes, those of equal texts included."""
    split = F.lower(F.trim("split"))
    side = F.when(split == "val", "a").when(split.isin("train", "pretrain"), "b")
    rows = rows.select("row_id", "corpus", "source", "split", side.alias("side"), "text").filter("side is not null and text is not null")
    marks = ", ".join(f"{s} long" for s in MARKS)
    rows = stage(rows.mapInPandas(_normal, f"row_id long, corpus string, source string, split string, side string, norm string, text_id string, n int, {marks}"), "rows")
    members = rows.select("side", "text_id", "row_id", "corpus", "source", "split")
    texts = stage(rows.groupBy("side", "text_id").agg(F.min("row_id").alias("key"), *[F.first(c).alias(c) for c in ("norm", "n", *MARKS)]), "texts")
    a, b = texts.filter("side = 'a'"), texts.filter("side = 'b'")

    long_a, long_b = (x.filter(F.col("n") >= FEWEST_WORDS) for x in (a, b))
    pieces = stage(b.select("norm").mapInPandas(_pieces, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "pieces")
    places = long_a.select("key", "norm").mapInPandas(_places, "key long, at int, h long, h2 long")
    places = places.join(pieces.withColumnRenamed("n", "one"), "h", "left").join(pieces.select(F.col("h").alias("h2"), F.col("n").alias("two")), "h2", "left")
    known = places.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("one", F.lit(0)).alias("one"), F.coalesce("two", F.lit(0)).alias("two")))).alias("p"))
    known = known.select("key", "p.one", "p.two").join(a.select("key", "norm", "n"), "key")
    index = stage(known.select("key", "norm", "n", "one", "two").mapInPandas(_index, "h long, key_a long, at_a int, n int"), "index")

    def of(side: DataFrame, name: str, *columns: str) -> DataFrame:
        return side.select(*[F.col(c).alias(f"{c}_{name}") for c in ("key", *columns)])

    probing = long_b.select("key", "norm", *MARKS)
    if 0 < index.count() <= INDEX_IN_TASKS:
        pairs = probing.mapInPandas(_probe_inside(index_arrays(index, long_a)), "key_a long, key_b long")
    else:
        probes = probing.mapInPandas(_probe(*index_filter(index)), "key_b long, m int, at_b int, h long, " + ", ".join(f"{s}_b long" for s in MARKS))
        shift = F.col("at_b") - F.col("at_a")
        most = F.ceil(F.greatest("n", "m") / F.lit(5)) - 1
        near = F.abs(shift) + F.abs(F.col("m") - F.col("n") - shift) <= most
        bits = reduce(lambda x, y: x + y, (F.bit_count(F.col(f"{s}_a").bitwiseXOR(F.col(f"{s}_b"))) for s in MARKS))
        indexed = index.join(of(a, "a", *MARKS), "key_a")
        pairs = probes.join(indexed.hint("shuffle_hash"), "h").filter(near & (bits <= 2 * most)).select("key_a", "key_b").distinct()
    pairs = stage(pairs, "pairs")
    pairs = pairs.join(of(a, "a", "text_id", "norm"), "key_a").join(of(b, "b", "text_id", "norm"), "key_b")
    pairs = pairs.select(F.col("text_id_a").alias("id_a"), F.col("text_id_b").alias("id_b"), "norm_a", "norm_b").filter("id_a != id_b")
    near = pairs.mapInPandas(_verify, "id_a string, id_b string, edits int")
    same = a.select(F.col("text_id").alias("id_a")).join(b.select(F.col("text_id").alias("id_b")), F.col("id_a") == F.col("id_b")).withColumn("edits", F.lit(0))
    return members, near.unionByName(same)


def split_overlaps(rows: DataFrame) -> DataFrame:
    """(val_row, train_row, edits): every val row with every training row that has the same or nearly the same text."""
    members, links = overlap_links(rows)
    va = members.filter("side = 'a'").select(F.col("text_id").alias("id_a"), F.col("row_id").alias("val_row")).distinct()
    tb = members.filter("side = 'b'").select(F.col("text_id").alias("id_b"), F.col("row_id").alias("train_row")).distinct()
    return links.join(va, "id_a").join(tb, "id_b").select("val_row", "train_row", "edits")


def overlap_report(rows: DataFrame) -> DataFrame:
    """Overlapping val rows, pairs of rows and equal pairs, per corpus and source of the val row and split and source of the
    training row: products of the classes' sizes, no pair of copies is written out."""
    members, links = overlap_links(rows)
    links = stage(links, "links")
    val = members.filter("side = 'a'").groupBy(F.col("text_id").alias("id_a"), F.col("corpus").alias("val_corpus"), F.col("source").alias("val_source")).agg(F.count(F.lit(1)).alias("val_n"))
    train = members.filter("side = 'b'").groupBy(F.col("text_id").alias("id_b"), F.col("split").alias("train_split"), F.col("source").alias("train_source")).agg(F.count(F.lit(1)).alias("train_n"))
    group = ["val_corpus", "val_source", "train_split", "train_source"]
    by_text = links.join(val, "id_a").join(train, "id_b").groupBy(*group, "id_a").agg(F.max("val_n").alias("val_n"), F.sum(F.col("val_n") * F.col("train_n")).alias("pairs"), F.sum(F.when(F.col("edits") == 0, F.col("val_n") * F.col("train_n")).otherwise(0)).alias("exact"))
    return by_text.groupBy(*group).agg(F.sum("val_n").alias("val_rows"), F.sum("pairs").alias("pairs"), F.sum("exact").alias("exact_pairs"))
