"""Held-out test items inside training documents: template windows of items, found in documents by a hash join.

Every text becomes a list of words (runs of letters and digits, lower case; tags, entities and a hyphen at a line break are
undone). Words are canonicalised: numbers, units and names (words that fewer than COMMON items use) become typed
placeholders, so a template window of an item meets a document although its numbers, names and units were exchanged.
Windows are joined by hash; then the slots of the windows of each document and item are compared:

* Windows whose slots hold the same values tell of the item itself. A leak is a run of RUN or more consecutive words of the
  item, or the whole item with at most one word in EDITS changed, dropped or added. Either one leaves at least
  `least_windows` windows with all their values, so every leak is a candidate; candidates are verified by the words.
* Windows that meet with other values, on one diagonal (the same distance between document and item), tell of a
  re-parameterised question: all of the item's words but one in EDITS meet their like there, slots by type, and the values
  of the slots are mapped one to one, some of them to another value.

The index of items is a table that Spark builds. Its templates are sent to the tasks, to leave out windows that no item has,
where there are at most TEMPLATES_IN_TASKS; else all windows are joined. The lexicon that tells slots from words holds the
WORDS_IN_TASKS words that most items use; a rarer word is a name, and at a hyphenated line break unknown.

Null and empty texts leak nothing. An item of fewer words than RUN can only be found whole. Equal items and equal
documents are found each under its own id.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .text import runs_of

RUN = 10
EDITS = 6
WINDOW = 5
COMMON = 3
WORDS_IN_TASKS = 1_000_000
TEMPLATES_IN_TASKS = 2_000_000
#: Units of measurement, as they appear after case and punctuation are dropped.
UNITS = frozenset("a bar c kpa kw m³ mm nm ppm rpm s h µm °c v hz mpa psi l kg t min".split())
NUMBER_SLOT, UNIT_SLOT, NAME_SLOT = 1, 2, 3
MIX = np.uint64(0x9E3779B97F4A7C15)

_TAG = re.compile(r"</?[a-zA-Z][\w:-]*(?:\s[^<>]*)?/?>")
_ENTITY = re.compile(r"&#?\w+;")
_BREAK = re.compile("([^\\W_]+)[-\u2010\u00ad][ \\t]*\\r?\\n\\s*([^\\W_]+)")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200d\u2060\ufeff]")


def split_words(text: str | None, known: dict | frozenset = frozenset()) -> list[str]:
    """Words of a text. At a hyphenated line break the two parts are one word if that word is known, else two."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = _ENTITY.sub(lambda m: html.unescape(m[0]), text)
    text = text.lower()
    if "\n" in text:
        text = _BREAK.sub(lambda m: m[1] + m[2] if m[1] + m[2] in known else f"{m[1]} {m[2]}", text)
    return runs_of(text if text.isascii() else _INVISIBLE.sub("", text))


def window_length(counts: list[int]) -> int:
    """The longest window that every leak of every item is sure to leave whole."""
    return max(1, min([WINDOW, *(n // (n // EDITS + 1) for n in counts if n)]))


def whole_windows(n: int, length: int) -> int:
    """So many windows an item of n words keeps whole at least, with one word in EDITS changed: each edit breaks `length` at most."""
    return max(1, n - length + 1 - length * (n // EDITS))


def least_windows(n: int, length: int) -> int:
    """Every leak of an item of n words leaves at least so many of its windows whole."""
    return min(whole_windows(n, length), RUN - length + 1) if n >= RUN else whole_windows(n, length)


def slot_of(word: str) -> int:
    return NUMBER_SLOT if word.isdigit() else UNIT_SLOT if word in UNITS else NAME_SLOT


class Lexicon:
    """The words of the items by number; those below FIRST stand for slots."""

    FIRST = 10

    def __init__(self, uses: dict[str, int], length: int):
        self.number = {w: i + self.FIRST for i, w in enumerate(sorted(uses))}
        kinds = [slot_of(w) if w.isdigit() or w in UNITS or uses[w] < COMMON else i for w, i in self.number.items()]
        self.kind = np.concatenate([np.arange(self.FIRST), np.array(kinds, dtype=int)]).astype(np.uint64)
        self.length = length

    def ids(self, words: list[str]) -> np.ndarray:
        """Item words by number; other words by the slot they would fill."""
        get = self.number.get
        return np.array([get(w) or slot_of(w) for w in words], dtype=np.uint64)

    def kinds(self, words: list[str]) -> np.ndarray:
        return self.kind[self.ids(words).astype(int)]

    def windows(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each window's template, and of its words."""
        n = len(ids) - self.length + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        kinds, template, whole = self.kind[ids.astype(int)], np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(self.length):
                template = (template ^ kinds[i : i + n]) * MIX ^ (template >> np.uint64(31))
                whole = (whole ^ ids[i : i + n]) * MIX ^ (whole >> np.uint64(31))
        return template.view(np.int64), whole.view(np.int64)


def _item_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        words = [split_words(t) for t in pdf["text"]]
        yield pd.DataFrame({"item_id": pdf["item_id"], "item_words": [" ".join(ws) for ws in words], "n": [len(ws) for ws in words]})


def _item_windows(lexicon: Lexicon) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for item, words in zip(pdf["item_id"], pdf["item_words"]):
                words = words.split(" ")
                template, whole = lexicon.windows(lexicon.ids(words))
                yield pd.DataFrame({"template": template, "item_whole": whole, "item_id": item, "item_at": np.arange(len(template), dtype=np.int32)})

    return run


def _document_windows(lexicon: Lexicon, templates: np.ndarray | None) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                words = split_words(text, lexicon.number)
                template, whole = lexicon.windows(lexicon.ids(words))
                if not len(template):
                    continue
                at = np.arange(len(template), dtype=np.int32)
                if templates is not None:
                    at = at[templates[np.minimum(np.searchsorted(templates, template), len(templates) - 1)] == template]
                if len(at):
                    out.append((doc, " ".join(words), template[at], whole[at], at))
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "words", "template", "whole", "at"])

    return run


def longest_run(doc: list[str], item: list[str], least: int) -> bool:
    if len(item) < least or len(doc) < least:
        return False
    runs = {tuple(item[i : i + least]) for i in range(len(item) - least + 1)}
    return any(tuple(doc[i : i + least]) in runs for i in range(len(doc) - least + 1))


def edits_within(doc: list[str], item: list[str]) -> int:
    """Fewest changed, dropped or added words that turn some passage of doc into item; bit-parallel in len(item)."""
    if not item:
        return 0
    at: dict[str, int] = {}
    for i, w in enumerate(item):
        at[w] = at.get(w, 0) | (1 << i)
    full, top = (1 << len(item)) - 1, 1 << (len(item) - 1)
    up, down, cost, best = full, 0, len(item), len(item)
    for w in doc:
        eq = at.get(w, 0)
        x = eq | down
        diagonal = (((x & up) + up) ^ up) | x
        plus, minus = down | (full & ~(diagonal | up)), up & diagonal
        cost += 1 if plus & top else -1 if minus & top else 0
        best = min(best, cost)
        plus, minus = plus << 1, minus << 1
        up, down = (minus & full) | (full & ~(diagonal | plus)), plus & diagonal & full
    return best


def slot_values(doc: list[str], item: list[str], kinds: tuple[np.ndarray, np.ndarray], shift: int) -> tuple[int, int, bool]:
    """On one diagonal: item words that meet their like, slots that hold another value, and whether values map one to one."""
    first, last = max(0, -shift), min(len(item), len(doc) - shift)
    a, b = kinds[1][first:last], kinds[0][first + shift : last + shift]
    alike = np.flatnonzero(a == b) + first
    there, back, other, clean = {}, {}, 0, True
    for i in alike:
        if kinds[1][i] < Lexicon.FIRST:
            x, y = item[i], doc[i + shift]
            clean = clean and there.setdefault(x, y) == y and back.setdefault(y, x) == x
            other += x != y
    return len(alike), other, clean


def _verify(lexicon: Lexicon) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc_id, item_id, doc, item, same, windows, shift, least in zip(pdf["doc_id"], pdf["item_id"], pdf["words"], pdf["item_words"], pdf["same"], pdf["windows"], pdf["shift"], pdf["least"]):
                doc, item, passage, edits, alike, other, clean = doc.split(" "), item.split(" "), False, None, 0, 0, False
                if same >= least:
                    passage = longest_run(doc, item, RUN)
                    edits = None if passage else edits_within(doc, item)
                leaks = passage or edits is not None and edits * EDITS <= len(item)
                if not leaks and not pd.isna(shift):
                    alike, other, clean = slot_values(doc, item, (lexicon.kinds(doc), lexicon.kinds(item)), int(shift))
                if leaks or clean and other and (len(item) - alike) * EDITS <= len(item):
                    out.append((doc_id, item_id, bool(leaks), bool(passage), edits, windows, same, alike, other))
            found = pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])
            yield found.astype({"edits": "Int32"})

    return run


RESULT = "doc_id long, item_id long, leaks boolean, passage boolean, edits int, windows long, same long, alike int, other_values int"


def item_matches(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, leaks, passage, edits, windows, same, alike, other_values): documents that hold an item or a passage of
    it (leaks), and documents that hold an item with other values.

    windows counts meetings of template windows, same those whose slots hold the same values. edits is counted only where no
    passage of RUN words decides, else null. alike (words that meet their like) and other_values (slots that don't hold the
    item's value) are of the items with other values.
    """
    spark = documents.sparkSession
    held = items.select("item_id", "text").filter("item_id is not null and text is not null").mapInPandas(_item_words, "item_id long, item_words string, n int").filter("n > 0")
    held = stage(held.distinct(), "items")
    n = F.col("n")
    length = held.agg(F.min(F.expr(f"n div (n div {EDITS} + 1)")).alias("length")).first()["length"]
    if length is None:
        return spark.createDataFrame([], RESULT)
    length = max(1, min(WINDOW, length))
    words = held.select(F.explode(F.array_distinct(F.split("item_words", " "))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("uses"))
    words = words.orderBy(F.col("uses").desc(), "word").limit(WORDS_IN_TASKS).toArrow().to_pandas()
    lexicon = Lexicon(dict(zip(words["word"], words["uses"])), length)
    index = stage(held.mapInPandas(_item_windows(lexicon), "template long, item_whole long, item_id long, item_at int"), "index")
    templates = index.select("template").distinct()
    small = templates.count() <= TEMPLATES_IN_TASKS
    known = np.sort(templates.toArrow()["template"].to_numpy()) if small else None

    hits = documents.select("doc_id", "text").filter("text is not null").mapInPandas(_document_windows(lexicon, known), "doc_id long, words string, template array<long>, whole array<long>, at array<int>")
    hits = stage(hits, "windows")
    # Shuffled once as arrays, by document: what follows, up to the pairs, is grouped within a document's partition.
    windows = hits.select("doc_id", "template", "whole", "at").repartition("doc_id").select("doc_id", F.explode(F.arrays_zip("template", "whole", "at")).alias("w")).select("doc_id", "w.template", "w.whole", "w.at")
    met = windows.join(F.broadcast(index) if small and index.count() <= TEMPLATES_IN_TASKS else index, "template")
    shifts = met.groupBy("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).agg(F.count(F.lit(1)).alias("windows"), F.count_if(F.col("whole") == F.col("item_whole")).alias("same"), F.min("item_at").alias("first"), F.max("item_at").alias("last"))
    # A run of windows holds length - 1 words more than windows, and there is a window missing between two runs at least.
    runs = F.least(F.col("windows"), F.col("last") - F.col("first") + 2 - F.col("windows"))
    most_alike = F.col("windows") + (length - 1) * runs
    pairs = shifts.groupBy("doc_id", "item_id").agg(F.sum("windows").alias("windows"), F.sum("same").alias("same"), F.max_by("shift", F.struct(most_alike, "windows", "shift")).alias("shift"), F.max(most_alike).alias("most_alike"))
    whole = F.greatest(F.lit(1), n - length + 1 - length * F.floor(n / EDITS))
    least = F.when(n >= RUN, F.least(whole, F.lit(RUN - length + 1))).otherwise(whole)
    texts = held.select("item_id", "item_words", "n", least.alias("least"))
    near = F.when((n - F.col("most_alike")) * EDITS <= n, F.col("shift")).alias("shift")
    pairs = pairs.join(texts.select("item_id", "n", "least"), "item_id").select("doc_id", "item_id", "windows", "same", "least", near).filter("same >= least or shift is not null")
    candidates = hits.select("doc_id", "words").join(pairs, "doc_id").join(texts.select("item_id", "item_words"), "item_id")
    return candidates.select("doc_id", "item_id", "words", "item_words", "same", "windows", "shift", "least").mapInPandas(_verify(lexicon), RESULT)


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold an item, or a passage of it, themselves."""
    return item_matches(documents, items).filter("leaks")
