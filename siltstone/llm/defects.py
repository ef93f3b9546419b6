"""Broken prompt and response pairs, by noisy labelling functions and a label model.

Each labelling function votes for a defect (1), against it (-1) or abstains (0). For every defect the votes of all rows are
counted by pattern, and an expectation-maximization label model learns from these counts how reliable each function is and
how common the defect; the counts have at most 3 ** functions rows, whatever the size of the data. A label is kept where its
posterior exceeds the cutoff that separates the inspected examples best; a row may keep several labels.

Whether a response breaks off is also judged from all responses: for the last words of a response without an end mark, how
often do the same words end a sentence elsewhere, and how often does a sentence go on after them? These counts cover every
response; the vocabulary that they are taken over holds only words that make up at least 1 in VOCABULARY_SHARE of all words,
so at most VOCABULARY_SHARE words are sent to the executors.

Defined results: a null response is empty; a null or blank question can neither be copied nor have a language; redelivered
rows are judged each by itself and get equal labels; very long responses are judged whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .text import runs_of

DEFECTS = ("empty", "copies_question", "refusal", "other_language", "truncated")
VOCABULARY_SHARE = 20_000
FRAME_SHARE = 800
CONTEXT = 8
ENOUGH = 4
ENDS, GOES_ON = 0.5, 0.12
ASKED_IN_TASKS = 2_000_000
FILTER_BITS = 24
MIX = np.uint64(0x9E3779B97F4A7C15)
ROUNDS = 40
STRENGTH = 30.0

#: Placeholders that stand for an empty answer.
PLACEHOLDERS = frozenset("n/a na none null nil nan tbd todo empty undefined unknown - -- --- ... … ? ?? ??? [] {} () <|assistant|> <|user|> <|system|> [empty] (empty) [none] [null] <empty> . no_response [no_response] #n/a".split())
#: Words that tell the language.
FUNCTION_WORDS = {
    "en": frozenset("the and of to is was were that for with at by from this had has have been which when what how should why does be are not it on because until an if can you i my your there".split()),
    "de": frozenset("der das und ist wird wurde nicht ein eine den dem des mit zu für auf im bei nach wenn muss sich als war wie warum welche kann man hat werden zum zur ich mir obwohl solange vor".split()),
    "fr": frozenset("le les des et est une du dans pour que qui sur au aux par pas avec été sont ne faut lors avant après pourquoi comment quelles doit il je à ou si sa mais vous".split()),
    "es": frozenset("el los las y del por para con una se que ha si su cada cómo qué ser sido debe cuando fue al durante según como más lo está no mientras después hacen falta".split()),
}
LETTERS = {"de": "äöüß", "fr": "èêàçùîâœ", "es": "ñ¿¡óíáú"}
LANGUAGE_NAMES = {"en": r"english|englisch|anglais|ingl[eé]s", "de": r"german|deutsch|allemand|alem[aá]n", "fr": r"french|franz[oö]sisch|fran[cç]ais|franc[eé]s", "es": r"spanish|spanisch|espagnol|espa[nñ]ol"}

_MARKER = re.compile(r"<\|[^|<>]*\|>")
_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"\b[a-zA-Z]{1,4}-\d+[a-zA-Z]?\b")
_NUMBER = re.compile(r"\d+(?:[.,]\d+)*")
_ITEM = re.compile(r"^\s*(?:\d{1,3}[.)]|[-*•])[ \t]+", re.M)
_TOKEN = re.compile(r"[@#]|[^\W\d_]+|[.!?…]+(?=\s|$)")
_BROKEN_ITEM = re.compile(r"(?:^|\n)\s*(?:\d{1,3}[.)]?|[-*•])\s*$")
_SENTENCE = re.compile(r"(?<=[.!?;:…])\s+|\n+")
_ABLE = r"(?:be able to )?(?:help|assist|answer|respond|reply|provide|comply|give|talk|discuss|comment|describe|share|do (?:that|this)|say|support|offer|tell|advise|proceed|continue|complete|fulfil|engage)"
_REFUSES = re.compile(
    rf"\b(?:can ?not|can['’]?t|could not|couldn['’]t|won['’]?t|will not|unable to|not able to|not allowed to|not permitted to|not authori[sz]ed to|rather not|prefer not to|not going to|not willing to|not comfortable)\s+{_ABLE}"
    r"|\bi(?: must| have to|['’]ll have to| need to)? (?:decline|refuse)\b|\b(?:have|need) to (?:decline|refuse)\b|\bmust decline\b|not sure how to proceed|no permission to|(?:do not|don['’]t|lack) (?:have )?(?:the |enough |any |sufficient )?(?:information|knowledge|permission)\b"
    r"|not possible for me|not be appropriate|outside what i|beyond what i|against my"
    r"|kann ich (?:leider )?(?:\w+ ){0,3}(?:nicht|keine)|darf ich (?:\w+ ){0,3}(?:nicht|keine)|(?:kann|darf|möchte|werde) (?:dazu|dabei|darüber|das) (?:\w+ )?nicht|keine auskunft|nicht (?:beantworten|helfen|weiterhelfen)"
    r"|je ne (?:peux|suis|sais|souhaite|saurais) pas|je refuse|(?:impossible|pas possible) (?:pour moi )?de (?:répondre|vous aider)|je n['’]ai pas (?:le droit|l['’]autorisation)"
    r"|no (?:puedo|podré|estoy autorizad[oa]|me es posible|tengo permiso|se me permite|dispongo)|me niego"
)
_SPEAKER = re.compile(r"\b(?:i|me|my|ich|mir|je|moi|puedo|estoy|lo siento|me niego|tengo|me es|désolé|sorry|answering)\b|\bi['’]")
_COURTESY = ("sorry", "apolog", "unfortunately", "regret", "respect", "thank", "understanding", "anything else", "please contact", "please ask", "try asking", "feel free", "let me know", "bitte", "fachkraft", "leid", "merci", "désolé", "adressez", "lo siento", "gracias", "consulte", "póngase")
_LEAD = 6
_MARKS = ".!?…"
#: Every language name that LANGUAGE_NAMES knows holds one of these, and every refusal that _REFUSES knows one of those.
_NAME_STEMS = ("engl", "angl", "ingl", "german", "deutsch", "allem", "alem", "french", "fran", "spani", "espa")
_REFUSAL_STEMS = (
    "cannot", "can not", "can't", "can’t", "cant ", "could not", "couldn", "won't", "won’t", "wont ", "will not", "unable to", "not able", "not allowed", "not permitted", "not authori",
    "rather not", "prefer not", "not going to", "not willing", "not comfortable", "decline", "refuse", "not sure how", "permission", "information", "knowledge", "not possible for me", "not be appropriate",
    "outside what", "beyond what", "against my", "kann ich", "darf ich", "nicht", "keine auskunft", "je ne", "impossible", "pas possible", "je n'ai pas", "je n’ai pas",
    "no puedo", "no podré", "no estoy", "no me es", "no tengo", "no se me", "no dispongo", "me niego",
)


def visible(text: str | None, enough: int = 32) -> str:
    """The visible characters of a text; no more than `enough` are looked for, since placeholders are shorter."""
    text = text or ""
    head = text[: 2 * enough]
    if head.isascii() and head.isprintable() and (len(head) - head.count(" ") >= enough or len(head) == len(text)):
        return head.replace(" ", "")[:enough]
    seen = (c for c in text if unicodedata.category(c)[0] not in "ZC" and c not in "\u2800\u3164\u115f\u1160")
    return "".join(islice(seen, enough))


def language(text: str | None, words: list[str] | None = None) -> str | None:
    text = (text or "").lower()
    words = runs_of(text) if words is None else words
    if not text.isascii() and any("\u4e00" <= w[0] <= "\u9fff" for w in words):
        return "zh"
    votes = sorted(((sum(map(known.__contains__, words)), code) for code, known in FUNCTION_WORDS.items()), reverse=True)
    return votes[0][1] if votes[0][0] >= 2 and votes[0][0] >= 1.4 * votes[1][0] else None


def letter_language(text: str | None) -> str | None:
    text = text or ""
    if text.isascii():
        return "en" if len(text) > 120 else None
    text = text.lower()
    votes = sorted(((sum(map(text.count, letters)), code) for code, letters in LETTERS.items()), reverse=True)
    if votes[0][0] >= 2 and votes[0][0] >= 2 * votes[1][0]:
        return votes[0][1]
    return "en" if votes[0][0] == 0 and len(text) > 120 else None


def _without(words: list[str], part: list[str]) -> tuple[int, int]:
    """How often part is in words, and how many words are left without it."""
    if not part or f" {' '.join(part)} " not in f" {' '.join(words)} ":
        return 0, len(words)
    found, at, left, n = 0, 0, 0, len(part)
    while at < len(words):
        if words[at] == part[0] and words[at : at + n] == part:
            found, at = found + 1, at + n
        else:
            left, at = left + 1, at + 1
    return found, left


def bare_text(text: str | None) -> str:
    """The text in lower case without chat markers."""
    text = text or ""
    return (_MARKER.sub(" ", text) if "<|" in text else text).lower()


def _bare(text: str | None) -> list[str]:
    return runs_of(bare_text(text))


def empty_votes(response: str | None) -> list[int]:
    response = response or ""
    plain = _MARKER.sub("", response) if "<|" in response else response
    seen, bare = visible(response), visible(plain)
    against = -1 if len(bare) > 16 else 0
    wordless = not any(map(str.isalnum, plain))
    return [1 if not seen else against, 1 if wordless or bare.lower().strip("\"'`*_") in PLACEHOLDERS else -1, 1 if wordless else against]


def copy_votes(question: str | None, response: str | None, words: tuple[list[str], list[str]] | None = None) -> list[int]:
    q, r = words or (_bare(question), _bare(response))
    if len(q) < 2 or not r:
        return [-1, -1, -1]
    found, left = _without(r, q)
    share = sum(map(set(q).__contains__, r)) / len(r)
    inside = len(r) >= 0.8 * len(q) and _without(q, r)[0] > 0
    return [1 if found and left <= _LEAD * found else -1, 1 if share >= 0.8 and len(r) >= 0.6 * len(q) else 0 if share >= 0.6 else -1, 1 if found and left <= len(q) // 2 or inside else -1 if left > 12 else 0]


def refusal_votes(response: str | None, words: list[str] | None = None) -> list[int]:
    text = " ".join((response or "").lower().split())
    if not text:
        return [0, 0, 0, 0]
    n = len(runs_of(text) if words is None else words)
    refuses = content = 0
    courtesy = any(map(text.__contains__, _COURTESY))
    sentences = 1 + sum(map(text.count, ".!?;:…"))
    if any(map(text.__contains__, _REFUSAL_STEMS)) and _REFUSES.search(text) or courtesy or n - 2 * sentences <= 14:
        for sentence in _SENTENCE.split(text):
            size = len(runs_of(sentence))
            if _REFUSES.search(sentence):
                refuses += 1
            elif size > 2 and not any(map(sentence.__contains__, _COURTESY)):
                content += size
    else:
        content = n  # no sentence refuses or is mere courtesy: there is content enough
    spoken = bool(refuses) and bool(_SPEAKER.search(text))
    return [1 if refuses and content <= 14 else -1 if content > 14 else 0, 1 if spoken else -1, 0 if n <= 45 and refuses else -1, 1 if courtesy and n <= 45 and refuses else 0]


def language_votes(system: str | None, question: str | None, response: str | None, words: tuple[list[str], list[str]] | None = None) -> list[int]:
    asked, given = (language(question), language(response)) if words is None else (language(question, words[0]), language(response, words[1]))
    said = f"{system or ''} {question or ''}".lower()
    wanted = {code for code, name in LANGUAGE_NAMES.items() if re.search(name, said)} if any(map(said.__contains__, _NAME_STEMS)) else set()
    shape_asked, shape_given = letter_language(question), letter_language(response)
    if not asked or not given:
        first = 0
    else:
        first = -1 if asked == given or given in wanted else 1
    if not shape_given or not asked or given in wanted:
        second = -1 if given in wanted else 0
    else:
        second = 1 if shape_given not in (asked, shape_asked) and shape_given not in wanted else -1 if shape_given == asked else 0
    return [first, second, -1 if wanted else 1 if first == 1 else 0]


def ended(response: str) -> bool:
    """Whether the response closes with an end mark, apart from what is no word: quotes, brackets, emoji."""
    text = response.rstrip()
    while text and not text[-1].isalnum() and text[-1] not in ".!?…。！？`,;:([{<-–—=+*/\\|&%":
        text = text[:-1].rstrip()
    return text.endswith((".", "!", "?", "…", "。", "！", "？", "```"))


def break_votes(response: str | None, tokens: list[str] | None = None) -> list[int]:
    """Votes on a broken end that need the response alone: code fence, list item, last mark."""
    text = (response or "").strip()
    if not visible(text) or len(tokens_of(text) if tokens is None else tokens) < 5:
        return [0, 0, -1]
    fences = text.count("```")
    item = "\n" in text and bool(_BROKEN_ITEM.search(text[text.rindex("\n") :]))
    mark = text.rstrip("\"'”’ ")[-1:]
    hangs = mark in ",:;([{=+-–—/&"
    return [1 if fences % 2 else -1 if fences else 0, 1 if item else 0, 1 if hangs else -1 if ended(text) and not item and not fences % 2 else 0]


def tokens_of(response: str | None) -> list[str]:
    """Words, @ for tags, # for numbers, end marks; list numbers and chat markers left out."""
    text = response or ""
    if "<|" in text:
        text = _MARKER.sub(" ", text)
    text = _ITEM.sub("", text)
    if "-" in text:
        text = _TAG.sub("@", text)
    return _TOKEN.findall(_NUMBER.sub("#", text).lower())


class Vocabulary:
    """Numbers of the frequent words; of these the very frequent ones make up the frames that sentences are built on."""

    END, START, RARE = 0, 1, 2

    def __init__(self, words: dict[str, int], total: int):
        self.number = {w: i + 3 for i, w in enumerate(sorted(words))}
        self.in_frame = np.array([False] * 3 + [words[w] * FRAME_SHARE >= total for w in sorted(words)])
        self.prefixes = {w[:k] for w in words for k in range(1, len(w))}

    def stream(self, texts: list[list[str]], frames: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """START before each sentence, its words, END after a closed one, all texts in a row, and the text of each place.

        In a frame the words between become one slot.
        """
        get = self.number.get
        codes = np.array([c if (c := get(t)) else self.END if t[0] in _MARKS else self.RARE for ts in texts for t in ts], dtype=np.int64)
        text = np.repeat(np.arange(len(texts)), [len(ts) for ts in texts])
        if not len(codes):
            return codes.astype(np.uint64), text
        fresh = np.concatenate([[True], (codes[:-1] == self.END) | (text[1:] != text[:-1])])
        keep = ~((codes == self.END) & fresh)
        opens = fresh & (codes != self.END)
        if frames:
            codes = np.where((codes > self.RARE) & ~self.in_frame[codes], self.RARE, codes)
            keep &= ~((codes == self.RARE) & ~fresh & np.concatenate([[False], codes[:-1] == self.RARE]))
        times = keep.astype(int) + opens
        out, where = np.repeat(codes, times), np.cumsum(times) - times
        out[where[opens]] = self.START
        return out.astype(np.uint64), np.repeat(text, times)

    @staticmethod
    def contexts(stream: np.ndarray, frames: bool = False) -> Iterator[np.ndarray]:
        """For k = 1, 2 ... the hash of the k numbers that end at each place from k - 1 on."""
        h = stream * MIX ^ np.uint64(100 * frames)
        for k in range(1, min(CONTEXT, len(stream)) + 1):
            if k > 1:
                with np.errstate(over="ignore"):
                    h = (h[1:] ^ stream[: len(stream) - k + 1]) * MIX ^ (h[1:] >> np.uint64(31))
            yield h.view(np.int64)


def _hash_filter(hashes: np.ndarray) -> np.ndarray:
    """A bit for each hash, to leave out most others before they are looked up."""
    marked = np.zeros(2**FILTER_BITS, bool)
    marked[hashes.view(np.uint64) >> np.uint64(64 - FILTER_BITS)] = True
    return np.packbits(marked, bitorder="little")


def _context_counts(vocabulary: Vocabulary, asked: np.ndarray | None):
    """For each context of a batch how often a sentence ends after it and how often it goes on; of `asked` ones if given."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = None if asked is None else _hash_filter(asked)
        for pdf in batches:
            tokens = [tokens_of(r) for r in pdf["response"]]
            for frames in (False, True):
                flat, text = vocabulary.stream(tokens, frames)
                if not len(flat):
                    continue
                # Nobody knows what would follow a response's last word.
                known = (flat >= Vocabulary.RARE) & np.concatenate([text[1:] == text[:-1], [False]])
                ends = np.concatenate([flat[1:] == Vocabulary.END, [False]])
                sentence = np.cumsum(flat == Vocabulary.START)
                for k, h in enumerate(Vocabulary.contexts(flat, frames), 1):
                    use = np.flatnonzero(known[k - 1 :] & (sentence[k - 1 :] == sentence[: len(h)]) & (flat[: len(h)] != Vocabulary.END))
                    if bits is not None:
                        place = h[use].view(np.uint64) >> np.uint64(64 - FILTER_BITS)
                        use = use[(bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1]
                        use = use[asked[np.minimum(np.searchsorted(asked, h[use]), len(asked) - 1)] == h[use]]
                    back, hashes = pd.factorize(h[use])
                    yield pd.DataFrame({"h": hashes, "ends": np.bincount(back, ends[k - 1 :][use], minlength=len(hashes)).astype(np.int64), "n": np.bincount(back, minlength=len(hashes))})

    return run


def _context_hashes(sentence: list[int], frames: bool) -> list[int]:
    """What Vocabulary.contexts gives at the last place, for k = 1, 2 ..."""
    mix, full, out = int(MIX), 0xFFFFFFFFFFFFFFFF, []
    for k in range(1, min(CONTEXT, len(sentence)) + 1):
        x = sentence[-k]
        out.append((x * mix & full) ^ 100 * frames if k == 1 else ((out[-1] ^ x) * mix & full) ^ (out[-1] >> 31))
    return [h - (1 << 64) if h >> 63 else h for h in out]


def _last_contexts(vocabulary: Vocabulary, tokens: list[str], frames: bool) -> list[int]:
    """Hashes of the contexts that end with the last word, the longest first; a frame needs two words besides slots."""
    last = max((i for i, t in enumerate(tokens[:-1]) if t[0] in _MARKS), default=-1)
    sentence = vocabulary.stream([tokens[last + 1 :]], frames)[0].tolist()
    hashes = _context_hashes(sentence, frames)
    return [hashes[k - 1] for k in range(len(hashes), 0, -1) if not frames or sum(x > Vocabulary.RARE for x in sentence[-k:]) >= 2]


def votes_of(vocabulary: Vocabulary, system: str | None, question: str | None, response: str | None) -> tuple:
    """The votes of a row for each of DEFECTS, and the contexts and frames that an open end asks for."""
    tokens = tokens_of(response)
    broken, contexts, frames, prefix = break_votes(response, tokens), [], [], 0
    text = (response or "").strip()
    if broken[2] == 0 and tokens and tokens[-1][0] not in _MARKS and not ended(text):
        contexts, frames = (_last_contexts(vocabulary, tokens, f) for f in (False, True))
        w = tokens[-1]
        prefix = 1 if w.isalpha() and w not in vocabulary.number and w in vocabulary.prefixes and text[-1:].isalnum() else 0
    words = _bare(question), _bare(response)
    return empty_votes(response), copy_votes(question, response, words), refusal_votes(response, words[1]), language_votes(system, question, response, words), [*broken, prefix], contexts, frames


def _row_votes(vocabulary: Vocabulary):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(row, *votes_of(vocabulary, *texts)) for row, *texts in zip(pdf["row_id"], pdf["system"], pdf["question"], pdf["response"])]
            yield pd.DataFrame(out, columns=["row_id", *DEFECTS, "contexts", "frames"])

    return run


def fit_label_model(patterns: dict[tuple[int, ...], int]) -> tuple[float, np.ndarray]:
    """Prior of the defect, and P(vote | class) of each function: EM over the counts of vote patterns."""
    votes, counts = np.array(list(patterns)), np.array(list(patterns.values()), float)
    width = votes.shape[1]
    belief = np.array([[0.60, 0.38, 0.02], [0.08, 0.17, 0.75]])  # class 0, class 1: against, abstain, for
    table, prior = np.repeat(belief[:, None], width, axis=1), 0.03
    for _ in range(ROUNDS):
        p = posterior(votes, prior, table)
        for c, q in ((0, 1 - p), (1, p)):
            seen = np.stack([[(counts * q * (votes[:, j] == v)).sum() for v in (-1, 0, 1)] for j in range(width)])
            table[c] = (seen + STRENGTH * belief[c]) / (seen.sum(1, keepdims=True) + STRENGTH)
        prior = ((counts * p).sum() + 1) / (counts.sum() + 30)
    return prior, table


def posterior(votes: np.ndarray, prior: float, table: np.ndarray) -> np.ndarray:
    logs = [np.log(table[c][np.arange(votes.shape[1]), votes + 1]).sum(1) for c in (0, 1)]
    return 1 / (1 + np.exp(np.clip(logs[0] + np.log(1 - prior) - logs[1] - np.log(prior), -500, 500)))


#: Inspected examples: system, question, response, the defect a reader finds.
_Q = "Why does the feed pump trip at 40 bar during the night shift? The seal was replaced."
_A = "The feed pump trips because the suction strainer was half closed. It should be cleaned every 30 days."
_OPEN = "The pump was checked before the next shift came in. "
_D = "Die Pumpe wurde nach dem Regen geprüft, und der Techniker hat keine Leckage gefunden. Das Lager ist in Ordnung."
EXAMPLES = (
    (None, _Q, _A, None),
    (None, _Q, _A[:-1], None),
    (None, _Q, "40 bar", None),
    (None, _Q, None, "empty"),
    (None, _Q, " \ufeff\n", "empty"),
    (None, _Q, "N/A", "empty"),
    (None, _Q, "—", "empty"),
    (None, _Q, "<|assistant|>", "empty"),
    (None, _Q, _Q.lower(), "copies_question"),
    (None, _Q, "You asked: " + _Q, "copies_question"),
    (None, _Q, _Q + "\n" + _Q, "copies_question"),
    (None, _Q, _Q + " " + _A + " " + _A, None),
    (None, _Q, "I'm sorry, but I can't help with that request.", "refusal"),
    (None, _Q, "Regrettably I have to decline this question", "refusal"),
    (None, _Q, "I am not permitted to talk about pumps. Please contact the shift supervisor.", "refusal"),
    (None, _Q, "The operator is not able to open the pump while it runs. " + _A, None),
    (None, _Q, "Unfortunately, the strainer was half closed. " + _A, None),
    (None, _Q, "I can't see the pump from here, but " + _A, None),
    (None, _Q, _D, "other_language"),
    ("Always answer in German.", _Q, _D, None),
    (None, "Warum hat die Pumpe nach dem Regen eine Leckage?", _A, "other_language"),
    (None, "Warum hat die Pumpe nach dem Regen eine Leckage?", _D, None),
    *[(None, _Q, _OPEN + end, None) for end in ("No further leak was seen once the shaft seal had been replaced", "This was unexpected, since the grouting had been swapped without stopping production", "It was agreed that the gasket had been fitted dry", "Nach 300 Stunden zeigte sich ein Versatz, obwohl alle Schrauben nachgezogen waren", "Der Grenzwert von 56.2 kW gilt nur, solange die Zentrifuge im Probenraum läuft", "Do not open the booster pump until the area operator has inspected the thermowell and the gauge shows 479.1 mm", "The vendor specialist reported 9 mm/s at the truck gantry, which is above the limit of 439.6 mm")],
    *[(None, _Q, _OPEN + end, "truncated") for end in ("No further leak was seen once the shaft", "This was unexpected, since the grouting had been", "The operator reported 12 bar at the seal, which is above the", "Do not open the pump until the crew has", "Nach 300 Stunden zeigte sich ein Versatz, obwohl alle", "Après 200 heures, le technicien n'a plus", "The trainee repor", "If the level gauge reaches 502 °C, the maint", "Leakage on the compressor was traced to the actuator diap", "Si el valor supera 9 ppm, la analista debe parar la bomba de inmedi")],
    (None, _Q, _A[:-14], "truncated"),
    (None, _Q, _A + "\n1. Clean the strainer.\n2.", "truncated"),
    (None, _Q, _A + "\n```python\nfor x in y:\n    total += x", "truncated"),
    (None, _Q, _A + "\n```python\nfor x in y:\n    total += x\n```", None),
    (None, _Q, _A + " The following points apply:", "truncated"),
)


def end_vote(broken: int, share: float | None) -> int:
    """Vote of the end-of-sentence counts: the share of like contexts that end a sentence, where the end is open."""
    if broken == -1 or share is not None and share >= ENDS:
        return -1
    return 1 if share is not None and share <= GOES_ON else 0


def example_votes(rows: list[tuple], shares: dict[tuple[int, str], float]) -> dict[str, np.ndarray]:
    """Votes on the inspected examples: rows of votes_of, and the counted shares of those that ask for them."""
    votes = {d: [list(row[i]) for row in rows] for i, d in enumerate(DEFECTS)}
    for i, v in enumerate(votes["truncated"]):
        v += [end_vote(v[2], shares.get((i, of))) for of in ("contexts", "frames")]
    return {d: np.array(v) for d, v in votes.items()}


def validated_cutoff(p: np.ndarray, truth: np.ndarray) -> float:
    """The cutoff of best F1 on the inspected examples, midway (in log odds) between two of their posteriors."""
    odds = np.unique(np.log(np.clip(p, 1e-12, 1 - 1e-12) / np.clip(1 - p, 1e-12, 1)))
    middles = np.concatenate([[0.0], (odds[1:] + odds[:-1]) / 2]) if len(odds) > 1 else np.zeros(1)
    grid = 1 / (1 + np.exp(-middles))
    f1 = np.array([2 * (truth & (p > c)).sum() / max(1, truth.sum() + (p > c).sum()) for c in grid])
    best = middles[f1 == f1.max()]
    return float(1 / (1 + np.exp(-best[np.argmin(np.abs(best))])))


def pair_labels(pairs: DataFrame) -> DataFrame:
    """(row_id, defect, posterior): every label of every row, several where their posteriors exceed their cutoffs."""
    pairs = pairs.select("row_id", "system", "question", "response")
    words = pairs.select(F.explode(F.regexp_extract_all(F.lower("response"), F.lit(r"[\p{L}]+"), F.lit(0))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    words = stage(words, "words")
    total = words.agg(F.sum("n").alias("n")).first()["n"] or 0
    frequent = {r["word"]: r["n"] for r in words.filter(F.col("n") >= max(3.0, total / VOCABULARY_SHARE)).collect()}
    vocabulary = Vocabulary(frequent | {"@": total, "#": total}, total)
    schema = "row_id long, " + ", ".join(f"{d} array<int>" for d in DEFECTS) + ", contexts array<long>, frames array<long>"
    rows = stage(pairs.mapInPandas(_row_votes(vocabulary), schema), "votes")
    examples = [votes_of(vocabulary, *texts) for *texts, _ in EXAMPLES]
    inspected = rows.sparkSession.createDataFrame([(i, list(c), list(f)) for i, (*_, c, f) in enumerate(examples)], "row_id long, contexts array<long>, frames array<long>")
    both = rows.select("row_id", F.lit(False).alias("example"), "contexts", "frames").unionByName(inspected.withColumn("example", F.lit(True)))
    asked = [both.select("row_id", "example", F.posexplode(of).alias("place", "h"), F.lit(of).alias("of")) for of in ("contexts", "frames")]
    asked = stage(asked[0].unionByName(asked[1]), "asked")
    hashes = asked.select("h").distinct()
    wanted = np.sort(hashes.toArrow()["h"].to_numpy()) if hashes.count() <= ASKED_IN_TASKS else None
    counts = pairs.select("response").filter("response is not null").mapInPandas(_context_counts(vocabulary, wanted), "h long, ends long, n long").groupBy("h").agg(F.sum("ends").alias("ends"), F.sum("n").alias("n"))
    # Short contexts are asked for by many rows: what is asked is met once, and an answer may be as large as what asks for it.
    known = asked.join(counts.filter(F.col("n") >= ENOUGH), "h").groupBy("row_id", "example", "of").agg(F.min_by((F.col("ends") + 0.5) / (F.col("n") + 1), "place").alias("share"))
    known = stage(known, "known")
    shares = {(r["row_id"], r["of"]): r["share"] for r in known.filter("example").collect()}
    known = known.filter("not example").groupBy("row_id").agg(*[F.max(F.when(F.col("of") == of, F.col("share"))).alias(f"{of}_share") for of in ("contexts", "frames")])
    closed = F.element_at("truncated", 3) == -1
    votes = [F.when(closed | (F.col(f"{of}_share") >= ENDS), -1).when(F.col(f"{of}_share") <= GOES_ON, 1).otherwise(0).cast("int") for of in ("contexts", "frames")]
    rows = rows.join(known, "row_id", "left").withColumn("truncated", F.concat("truncated", F.array(*votes))).select("row_id", *DEFECTS)
    rows = stage(rows, "votes")
    # An example that ends openly, in a whole word, validates only where the counts know its end by words and by frame.
    open_ended = [i for i, (*_, broken, contexts, frames) in enumerate(examples) if contexts and not any(broken)]
    told = np.array([i not in open_ended or all((i, of) in shares for of in ("contexts", "frames")) for i in range(len(examples))])
    examples, labels = example_votes(examples, shares), np.array([label or "" for *_, label in EXAMPLES])
    found = None
    for defect in DEFECTS:
        patterns = {tuple(r[defect]): r["n"] for r in rows.groupBy(defect).agg(F.count(F.lit(1)).alias("n")).collect()}
        if not patterns:
            continue
        prior, table = fit_label_model(patterns)
        use = told if defect == "truncated" else np.ones(len(labels), bool)
        cutoff = validated_cutoff(posterior(examples[defect][use], prior, table), labels[use] == defect)
        every = np.array(list(patterns))
        kept = [(list(map(int, v)), float(p)) for v, p in zip(every, posterior(every, prior, table)) if p > cutoff]
        if kept:
            chosen = rows.sparkSession.createDataFrame(kept, f"{defect} array<int>, posterior double")
            part = rows.join(F.broadcast(chosen), defect).select("row_id", F.lit(defect).alias("defect"), "posterior")
            found = part if found is None else found.unionByName(part)
    return found if found is not None else rows.sparkSession.createDataFrame([], "row_id long, defect string, posterior double")


def pair_defects(pairs: DataFrame) -> DataFrame:
    """One defect for each defective row: the first, in the order of DEFECTS, of its labels."""
    rank = F.array_position(F.array(*map(F.lit, DEFECTS)), F.col("defect"))
    return pair_labels(pairs).groupBy("row_id").agg(F.min_by("defect", rank).alias("defect"))
