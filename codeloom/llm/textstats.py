"""Statistics of lines and documents of scanned text, computed for whole Arrow batches at once.

Each distinct word of a batch is looked at once; lines and documents are sums over the words' properties.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Letters that scans confuse; they are read alike when words are compared.
CONFUSED = str.maketrans({"ſ": "s", "0": "o", "1": "l", "5": "s", "8": "b", "9": "g", "í": "i", "ï": "t"})
BULLETS = frozenset("-–—*•§+·○●■□►")
HYPHENS = ("-", "=", "¬", "‐", "‑", "\xad")
VOWELS = frozenset("aeiouyäöüáéíóúàèìòùâêîôûæœåø")
HASH_BITS = 18

WORD = ["letters", "digits", "symbols", "alpha", "lower", "capital", "upper", "single", "numeric", "terminal", "comma", "hyphen", "bullet", "vowelless", "punct", "odd", "repeated", "leader", "common"]
W = {name: k for k, name in enumerate(WORD)}
_REPEATED = re.compile(r"(.{2,8}?)\1{1,}[.\-,;]?$")
_NUMBER = re.compile(r"[\"(]?[\d½¼¾/.,:]++[a-z]{0,2}[.,;:)]?$")  # and a digit in it
_ENUM = re.compile(r"\(?\d{1,3}[.)]?$")


def fold(word: str) -> str:
    return word.lower().translate(CONFUSED)


def word_properties(w: str, common: frozenset[str]) -> list[float]:
    letters = digits = odd = 0
    for c in w:
        if c.isalpha():
            letters += 1
        elif c.isdigit() or c in "½¼¾":
            digits += 1
        elif ord(c) > 0x2100 or unicodedata.category(c) in ("Co", "Cn", "Cc"):
            odd += 1
    symbols = len(w) - letters - digits
    core = w.strip(".,;:!?()[]\"'»«„“”—–-=¬‐‑\xad|*•§+")
    alpha = letters > 0 and letters >= 0.6 * len(w)
    only = core if core.isalpha() else "".join(c for c in core if c.isalpha())
    low = only.lower()
    return [
        letters, digits, symbols, alpha, alpha and only[:1].islower(), alpha and only[:1].isupper() and not (len(only) > 1 and only.isupper()),
        alpha and len(only) > 1 and only.isupper(), letters == 1 and digits == 0, digits > 0 and bool(_NUMBER.match(w)), w[-1] in ".!?" and letters > 1, w[-1] in ",;:",
        letters > 0 and w.endswith(HYPHENS), w in BULLETS or bool(_ENUM.match(w)), len(low) >= 3 and alpha and not VOWELS.intersection(low), letters + digits == 0,
        odd > 0, len(only) >= 4 and bool(_REPEATED.match(w)), ".." in w or ".,." in w or w == ".", bool(core) and fold(core) in common,
    ]


class Lines:
    """The non-blank lines of a batch of texts: words, their properties, and where lines and documents begin."""

    def __init__(self, texts: pa.Array, common: dict[str, frozenset[str]]):
        every = frozenset().union(*common.values()) if common else frozenset()
        n = len(texts)
        lines = pc.split_pattern(pc.fill_null(texts, "").cast(pa.large_string()), "\n")
        counts = pc.list_value_length(lines).to_numpy(zero_copy_only=False)
        doc, flat = np.repeat(np.arange(n), counts), pc.utf8_trim_whitespace(lines.flatten())
        keep = pc.not_equal(pc.utf8_length(flat), 0)
        self.doc, self.text, self.n_docs = doc[keep.to_numpy(zero_copy_only=False)], flat.filter(keep), n
        split = pc.utf8_split_whitespace(self.text)
        self.words = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        self.ends = np.cumsum(self.words)
        self.starts = self.ends - self.words
        coded = split.flatten().dictionary_encode()
        self.code = coded.indices.to_numpy(zero_copy_only=False)
        names = coded.dictionary.to_pylist()
        self.props = np.array([word_properties(w, every) for w in names], np.float32).reshape(len(names), len(WORD))
        self.hash = np.array([hash32(w) for w in names], np.uint32)
        cores = [fold(w.strip(".,;:!?()\"'")) for w in names]
        self.by_lang = np.array([[c in s for s in common.values()] for c in cores], np.float32).reshape(len(names), len(common))
        self.line_of_word = np.repeat(np.arange(len(self.words)), self.words)
        self.doc_starts = np.searchsorted(self.doc, np.arange(n + 1))

    def sum_words(self, values: np.ndarray) -> np.ndarray:
        """Sums over the words of each line of a value per word or, for 2-d values, of several."""
        if not len(self.starts):
            return np.zeros((0, *values.shape[1:]), values.dtype)
        return np.add.reduceat(values, self.starts, axis=0)

    def sum_lines(self, values: np.ndarray) -> np.ndarray:
        """Sums over the lines of each document."""
        total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
        np.cumsum(values, axis=0, out=total[1:])
        return total[self.doc_starts[1:]] - total[self.doc_starts[:-1]]


@lru_cache(maxsize=1 << 16)
def hash32(word: str) -> int:
    h = 2166136261
    for c in fold(word.strip(".,;:!?()\"'")).encode():
        h = (h ^ c) * 16777619 & 0xFFFFFFFF
    return h


def pair_codes(x: Lines) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word with the one after it in the document, and which of them stay in a line; -1 at the last word."""
    h = x.hash[x.code].astype(np.uint64)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    nxt = np.append(h[1:], np.uint64(0))
    pair = ((h * np.uint64(0x9E3779B97F4A7C15) ^ nxt) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(64 - HASH_BITS)).astype(np.int64)
    line = x.line_of_word
    doc = x.doc[line]
    pair[:-1][doc[1:] != doc[:-1]] = -1
    pair[-1] = -1
    inside = np.append(line[1:] == line[:-1], False)
    return pair, inside


def line_features(x: Lines, known: np.ndarray) -> np.ndarray:
    """A row of features for each line. known: for each pair hash how many labelled running texts have it."""
    n = len(x.words)
    if not n:
        return np.zeros((0, N_FEATURES), np.float32)
    props = x.props[x.code]
    sums, words = x.sum_words(props), x.words[:, None].astype(np.float32)
    share = sums / words
    first, last = props[x.starts], props[x.ends - 1]
    chars = pc.utf8_length(x.text).to_numpy(zero_copy_only=False).astype(np.float32)
    gaps = np.minimum(pc.count_substring_regex(x.text, r"\t| {3,}").to_numpy(zero_copy_only=False), 5).astype(np.float32)
    pair, inside = pair_codes(x)
    familiar = np.where(pair >= 0, known[pair] > 0, False).astype(np.float32)
    in_line = x.sum_words(familiar * inside) / np.maximum(x.words - 1, 1)
    cross = familiar[x.ends - 1]

    longest = np.zeros(x.n_docs, np.float32)
    np.maximum.at(longest, x.doc, chars)
    fill = chars / longest[x.doc]
    same_next = np.append(x.doc[1:] == x.doc[:-1], False)
    same_prev = np.insert(same_next[:-1], 0, False)
    flows = same_next & (last[:, W["terminal"]] == 0) & (np.append(first[1:, W["lower"]], 0) > 0)
    flowed = np.insert(flows[:-1], 0, False)
    base = np.column_stack([
        share, first[:, [W["bullet"], W["lower"], W["capital"], W["numeric"], W["punct"]]], last[:, [W["terminal"], W["comma"], W["hyphen"], W["numeric"], W["lower"]]],
        np.log1p(words), np.log1p(chars), sums[:, 0] / np.maximum(sums[:, W["alpha"]], 1), sums[:, 1] / chars, sums[:, 2] / chars, gaps, fill,
        flows, flowed, same_next, same_prev, in_line, cross, np.insert(cross[:-1], 0, 0) * same_prev,
    ]).astype(np.float32)
    # what the lines around and the whole document look like
    count = np.maximum(np.diff(x.doc_starts), 1)[x.doc][:, None]
    mean = x.sum_lines(base)[x.doc] / count
    up = np.where(same_prev[:, None], np.vstack([base[:1], base[:-1]]), base)
    down = np.where(same_next[:, None], np.vstack([base[1:], base[-1:]]), base)
    return np.column_stack([base, (up + down) / 2, mean, np.log1p(count)]).astype(np.float32)


N_FEATURES = 3 * (len(WORD) + 24) + 1

STATS = ["n_lines", "n_words", "mean_word_length", "symbol_ratio", "punctuated_lines", "common_words"]


def document_stats(x: Lines) -> dict[str, np.ndarray]:
    """The statistics of each document (0 where it has no words), and the number of its language, -1 if none can be told."""
    n_lines = np.diff(x.doc_starts)
    props = x.props[x.code]
    by_line = x.sum_words(props)
    total = x.sum_lines(by_line)
    words = x.sum_lines(x.words.astype(np.float64))
    last = props[x.ends - 1] if len(x.ends) else np.zeros((0, len(WORD)), np.float32)
    ended = x.sum_lines(np.maximum(last[:, W["terminal"]], last[:, W["comma"]]))
    chars = total[:, :3].sum(axis=1)
    some = np.maximum(words, 1)
    langs = x.sum_lines(x.sum_words(x.by_lang[x.code])) if x.by_lang.shape[1] else np.zeros((x.n_docs, 1))
    lang = np.where(langs.max(axis=1) > 0, langs.argmax(axis=1), -1)
    return {
        "n_lines": n_lines.astype(np.int64), "n_words": words.astype(np.int64), "mean_word_length": total[:, 0] / np.maximum(total[:, W["alpha"]], 1), "symbol_ratio": total[:, 2] / np.maximum(chars, 1),
        "punctuated_lines": ended / np.maximum(n_lines, 1), "common_words": total[:, W["common"]] / some, "lang_no": lang.astype(np.int32),
    }
