"""BPE encoding by backtracking over Aho-Corasick matches, decoding by an offset table.

A word's possible tokens are found in one pass of an Aho-Corasick automaton. The encoder takes the longest token at
each place and steps back to shorter ones where two neighbours could not both come out of the merges: a pair is
compatible if undoing merges on either side of their border meets no earlier merge across it. Places from which the
word can't be finished are marked, so each is tried once. Results equal those of the merge procedure.

The vocabulary file is given by path; it must hold a BPE model with word ends whose merged tokens are numbered in
the order of the merges.

Defined cases: a null text is empty and has no tokens; the special tokens' own strings become their ids, as the
library does; equal texts have equal ids; words seen are remembered in two generations of ``WORDS`` each, and forgotten at a task's end.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .common import series_udf, small_batches, text_or_empty, tidy

WORDS = 100_000
END = "\x00"
#: Texts of code points below this take the shorter pattern: all tables agree there.
NEAR = 0x558
#: White space as regular expressions of Unicode engines define it.
SPACES = r"\t-\r \x85\xa0  -     　"

#: Code points that the regular expressions here count as letters or digits and the tokenizers library,
#: whose tables are of Unicode 16, does not.
LATER_LETTERS = (
    "\\u0558\\u058b\\u058c\\u088f\\u0c5c\\u0cdc\\u208f\\u209d-\\u209f\\ua7ce\\ua7cf\\ua7d2\\ua7d4\\ua7dd\\ua7e2\\ua7f1\\uab6c\\uab6d"
    "\\U000107bb-\\U000107bf\\U00010940-\\U00010959\\U00010ec5-\\U00010ec7\\U00010ed9-\\U00010eee\\U00011b0a\\U00011db0-\\U00011ddb\\U00011df1"
    "\\U00016ea0-\\U00016eb8\\U00016ebb-\\U00016ed3\\U00016ff2\\U00016ff3\\U000187f8-\\U000187ff\\U00018cd6-\\U00018cda\\U00018d09-\\U00018d20"
    "\\U00018d80-\\U00018df2\\U00018e00-\\U00019191\\U000191a0-\\U000191d2\\U0001b123-\\U0001b128\\U0001b168\\U0001d6a6\\U0001df1f-\\U0001df24"
    "\\U0001df2b-\\U0001df81\\U0001df90-\\U0001df96\\U0001dfcd-\\U0001dfff\\U0001e6c0-\\U0001e6de\\U0001e6e0-\\U0001e6e2\\U0001e6e4\\U0001e6e5"
    "\\U0001e6e7-\\U0001e6ed\\U0001e6f0-\\U0001e6f4\\U0001e6fe\\U0001e6ff\\U0002b73a-\\U0002b73f\\U0002b81e\\U0002cea2-\\U0002cead"
    "\\U000323b0-\\U00033479\\U0003d000-\\U0003fc3f"
)
LATER_DIGITS = "\\U00011de0-\\U00011de9\\U0001246f\\U00012475-\\U0001247f\\U00012550-\\U00012686\\U00016ff4-\\U00016ff6"
#: Capitals that Python's older tables lack; and a capital sigma never becomes the final form.
LATER_LOWER = {0x3A3: 0x3C3, 0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
LATER_LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}


def byte_letters() -> list[str]:
    """Byte-level BPE writes each byte as a printable letter: itself where printable, else from 256 upwards."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


class _Seen(dict):
    """Ids by word; a word that is not there is taken from the older generation or encoded."""

    def __init__(self, owner: "WordBPE"):
        super().__init__()
        self.owner, self.older = owner, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            own = self.owner
            ids = own.word(word.encode("utf-8", "replace").decode("latin-1").translate(own.table))
        self[word] = ids
        return ids

    def age(self) -> None:
        """What was seen of late becomes the older generation; words not met in two of them are forgotten."""
        self.older = dict(self)
        self.clear()

    def forget(self) -> None:
        self.older = {}
        self.clear()


class WordBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != "</w>" or spec.get("decoder"):
            raise ValueError("a BPE vocabulary with word ends and no decoder is needed")
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.letters = byte_letters()
        self.table = str.maketrans({b: c for b, c in enumerate(self.letters)})
        pieces = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.pair = {(vocab[a], vocab[b]): vocab[a + b] for a, b in pieces}
        self.halves = {t: p for p, t in self.pair.items()}
        self.compatible: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        self.length = {}
        for token, i in vocab.items():
            own = token[:-4] + END if token.endswith("</w>") and len(token) > 4 else token
            self.length[i] = len(own)
            self.automaton.add_word(own, (i, len(own)))
        self.automaton.make_automaton()
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        letters, digits = rf"[\p{{L}}--[{LATER_LETTERS}]]", rf"[\p{{N}}--[{LATER_DIGITS}]]"
        pattern = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{SPACES}{letters}{digits}]").replace(r"[\p{L}]", letters).replace(r"[\p{N}]", digits)
        self.words = regex.compile(pattern, regex.V1)
        near = [chr(c) for c in range(NEAR)]
        groups = [[c for c in near if regex.match(p, c)] for p in (r"\p{L}", r"\p{N}", rf"[^{SPACES}\p{{L}}\p{{N}}]")]
        one, two, rest = ("[" + "".join(map(re.escape, g)) + "]" for g in groups)
        short = [x for x in pattern.split("|") if x.startswith("'")]
        self.near_words = re.compile("|".join([*short, one + "+", two, rest + "+"]))
        self.far = re.compile(f"[^\\x00-{chr(NEAR - 1)}]")
        self.spaces = regex.compile(f"[{SPACES}]+")
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.seen = _Seen(self)
        size = max([*vocab.values(), *self.special.values()]) + 1
        names = [b""] * size
        for token, i in [*vocab.items(), *self.special.items()]:
            names[i] = token.encode() + b" "
        self.blob = np.frombuffer(b"".join(names), np.uint8)
        self.widths = np.fromiter(map(len, names), np.int64, size)
        self.offsets = np.concatenate([[0], np.cumsum(self.widths)[:-1]])

    def fits(self, left: int, right: int) -> bool:
        """Whether two neighbouring tokens both survive the merges, remembered by pair."""
        known = self.compatible.get((left, right))
        if known is None:
            known = self.compatible[left, right] = self._fits(left, right)
        return known

    def _fits(self, left: int, right: int) -> bool:
        """Undo the later merge beside the border again and again; an earlier merge across it forbids the pair."""
        latest = float("inf")
        while True:
            across = self.pair.get((left, right))
            if across is not None and across < latest:
                return False
            left_parts, right_parts = self.halves.get(left), self.halves.get(right)
            if left_parts and (left > right or not right_parts):
                latest, left = left, left_parts[1]
            elif right_parts:
                latest, right = right + 1, right_parts[0]
            else:
                return True

    def word(self, letters: str) -> bytes:
        """Ids of one word (byte letters) as little-endian 32-bit integers."""
        text = letters + END
        n = len(text)
        at: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, (token, size) in self.automaton.iter(text):
            at[end - size + 1].append((token, size))
        alive = [True] * (n + 1)
        out: list[tuple[int, int]] = []  # token and its place in the list of its start
        pos, choice = 0, len(at[0]) - 1
        while pos < n:
            options = at[pos]
            while choice >= 0:
                token, size = options[choice]
                if alive[pos + size] and (not out or self.fits(out[-1][0], token)):
                    break
                choice -= 1
            if choice >= 0:
                out.append((token, choice))
                pos += size
                choice = len(at[pos]) - 1 if pos < n else -1
            else:
                alive[pos] = False
                if not out:
                    raise ValueError("the vocabulary can't spell this word")
                token, choice = out.pop()
                pos -= self.length[token]
        return np.array([t for t, _ in out], "<u4").tobytes()

    def _plain(self, text: str) -> bytes:
        """Ids of text without special tokens."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if self.far.search(text):
            found = self.words.findall(self.spaces.sub(" ", text.translate(LATER_LOWER)).lower())
        else:
            found = self.near_words.findall(text.replace("Σ", "σ").lower())
        if len(self.seen) > WORDS:
            self.seen.age()
        return b"".join(map(self.seen.__getitem__, found))

    def encode(self, text: str) -> bytes:
        if self.cut is None or "<|" not in text:
            return self._plain(text)
        out, last = [], 0
        for m in self.cut.finditer(text):
            out += [self._plain(text[last : m.start()]), np.array([self.special[m[0]]], "<u4").tobytes()]
            last = m.end()
        return b"".join([*out, self._plain(text[last:])])

    def decode(self, ids: bytes) -> bytes:
        """The tokens' strings with a space between them, gathered from one blob by offsets."""
        i = np.frombuffer(ids, "<u4")
        if not len(i):
            return b""
        width = self.widths[i]
        ends = np.cumsum(width)
        source = np.repeat(self.offsets[i] - ends + width, width) + np.arange(ends[-1])
        return self.blob[source].tobytes()[:-1]


_LOADED: dict[str, WordBPE] = {}


def load(path: str) -> WordBPE:
    """One tokenizer a worker process and path."""
    if path not in _LOADED:
        _LOADED[path] = WordBPE(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str, text_col: str = "text") -> Column:
    """Token ids of a text as little-endian 32-bit integers in a binary column."""
    small_batches(docs.sparkSession)

    @F.pandas_udf(BinaryType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = load(path)
        try:
            for texts in batches:
                yield pd.Series([t.encode(x) for x in texts], dtype=object)
        finally:  # workers outlive tasks: words seen would stay in their memory
            t.seen.forget()
            t.compatible.clear()
            tidy()

    return run(text_or_empty(text_col))


def decode(ids: Column, path: str) -> Column:
    """The decoded text of a column of ids."""

    def run(col: pd.Series) -> pd.Series:
        t = load(path)
        return pd.Series([t.decode(bytes(x)).decode("utf-8") for x in col], dtype=object)

    return series_udf(run, "string")(ids)


def round_trip(docs: DataFrame, path: str, text_col: str = "text") -> Column:
    """A struct of a text's ids, as ``encode`` gives them, and of what they decode to: one Python worker a task for both."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("ids binary, decoded string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        t = load(path)
        try:
            for texts in batches:
                ids = [t.encode(x) for x in texts]
                yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": pd.Series([t.decode(x).decode("utf-8") for x in ids], dtype=object)})
        finally:
            t.seen.forget()
            t.compatible.clear()
            tidy()

    return run(text_or_empty(text_col))


def ids_array(ids: Column) -> Column:
    """The ids of a binary column as an array of longs, for users of single ids."""
    n = (F.octet_length(ids) / 4).cast("int")
    byte = lambda i, k: F.conv(F.hex(F.substring(ids, i * 4 + k + 1, F.lit(1))), 16, 10).cast("long")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: byte(i, 0) + byte(i, 1) * 256 + byte(i, 2) * 65536 + byte(i, 3) * 16777216)).otherwise(F.array().cast("array<long>"))
