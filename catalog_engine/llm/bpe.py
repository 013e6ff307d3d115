"""BPE encoding and decoding by dynamic programming over prefixes (operator 3).

For each prefix of a word exactly one token can end its encoding. An automaton over the vocabulary
gives the tokens that are suffixes of the prefix; a token is the last one if it is compatible with
the last token of the prefix before it, that is, if no merge of higher priority crosses the place
where the two meet. Following the stored tokens back from the end gives the ids. The work grows
linearly with the word, however long it is.

A null text counts as empty: no tokens, and the decoded text is empty. Repeated rows give repeated
rows, an empty table an empty one; columns besides the two named ones are not read.
"""

from __future__ import annotations

import json
from functools import lru_cache
from unicodedata import category, normalize

import ahocorasick
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from catalog_engine.llm.common import map_rows
from catalog_engine.llm.memo import Memo

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")

#: Unicode white space, which ends a word. (str.split() would end words at U+001C to U+001F too.)
BLANK = "\t-\r \x85\xa0  -     　"
_NOT_BLANK = ("\x1c", "\x1d", "\x1e", "\x1f")
_BLANKS = regex.compile(f"[{BLANK}]+")
_END = "\0"  # no byte is shown as this character
_COMPATIBLE = 1 << 20
_MARKS = frozenset(".,;:!?")  # each is a piece by itself behind letters


def byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in shown}
    for b in range(256):
        letters.setdefault(b, chr(256 + len(letters) - len(shown)))
    return [letters[b] for b in range(256)]


def words_of(text: str) -> list[str]:
    if any(c in text for c in _NOT_BLANK):
        return [w for w in _BLANKS.split(text) if w]
    return text.split()


class WordBpe:
    """The vocabulary of one file: BPE with word ends over lower-cased byte letters."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        model = made["model"]
        self.suffix = model["end_of_word_suffix"]
        self.ids: list[int] = []
        self.shown: list[str] = []
        vocabulary = model["vocab"]
        number = {token: n for n, token in enumerate(vocabulary)}
        self.ids, self.shown = list(vocabulary.values()), list(vocabulary)
        self.rank = [-1] * len(number)
        self.left, self.right = [0] * len(number), [0] * len(number)
        self.merges: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            whole, x, y = number[a + b], number[a], number[b]
            self.merges[x, y] = rank
            self.rank[whole], self.left[whole], self.right[whole] = rank, x, y
        self.known: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        specials = {t["content"]: t["id"] for t in made["added_tokens"]}
        for token, n in number.items():
            if token in specials:
                continue
            # A token that merges inside it would break up never ends a prefix.
            if self.rank[n] < 0 or self._meet(self.left[n], self.right[n], self.rank[n]):
                text = token.removesuffix(self.suffix) + _END if token.endswith(self.suffix) else token
                self.automaton.add_word(text, (n, len(text)))
        self.automaton.make_automaton()
        self.specials = specials
        self.special = regex.compile("(" + "|".join(map(regex.escape, specials)) + ")")
        self.pieces = regex.compile(
            rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{BLANK}\p{{L}}\p{{N}}]+"
        )
        self.letters = byte_letters()
        self.rules = Tokenizer.from_file(path)
        self.by_id = {i: token for token, i in (vocabulary | specials).items()}

    def _meet(self, x: int, y: int, limit: int) -> bool:
        """Whether BPE leaves the place between two tokens alone. Takes both apart, the younger
        token first; a merge across the place that comes before ``limit`` would have been made."""
        merges, rank = self.merges, self.rank
        while True:
            across = merges.get((x, y))
            if across is not None and across < limit:
                return False
            a, b = rank[x], rank[y]
            if a > b:
                limit, x = a, self.right[x]
            elif b >= 0:
                limit, y = b + 1, self.left[y]
            else:
                return True

    def compatible(self, x: int, y: int) -> bool:
        key = x << 20 | y
        known = self.known.get(key)
        if known is None:
            if len(self.known) >= _COMPATIBLE:
                self.known.clear()
            known = self.known[key] = self._meet(x, y, len(self.merges) + 1)
        return known

    def tokens(self, word: str) -> list[int]:
        """Token numbers of one word in byte letters."""
        size = len(word)
        last, before = [-1] * (size + 2), [0] * (size + 2)
        known = self.known
        for end, (token, length) in self.automaton.iter(word + _END):
            end += 1
            if last[end] < 0 and end != size:
                start = end - length
                if start:
                    fits = known.get(last[start] << 20 | token)
                    if not (self.compatible(last[start], token) if fits is None else fits):
                        continue
                last[end], before[end] = token, start
        out, at = [], size + 1
        while at:
            out.append(last[at])
            at = before[at]
        return out[::-1]

    def word_tokens(self, word: str) -> list[int]:
        """Ids of one run of text without white space."""
        out: list[int] = []
        for part in self.special.split(word) if "<|" in word else (word,):
            if part in self.specials:
                out.append(self.specials[part])
            elif part:
                for piece in self.split(part):
                    out += [self.ids[n] for n in self.tokens(piece)]
        return out

    def split(self, text: str) -> list[str]:
        """Pieces of a text in byte letters."""
        if text.isascii():
            # Most words are letters alone, or with one mark behind them.
            if text.isalpha():
                return [text.lower()]
            if text[-1] in _MARKS and text[:-1].isalpha():
                return [text[:-1].lower(), text[-1]]
        elif any(category(c) == "Cn" for c in text):
            # Unicode tables of different years class such characters differently: ask the file's.
            text = self.rules.normalizer.normalize_str(text)
            return [piece for piece, _ in self.rules.pre_tokenizer.pre_tokenize_str(text)]
        return [
            piece
            if piece.isascii() and piece.isprintable()
            else "".join([self.letters[b] for b in piece.encode()])
            for piece in self.pieces.findall(_lower(text))
        ]

    def decode(self, ids: list[int]) -> str:
        """As the vocabulary file says: it has no decoder, so tokens are joined by one space."""
        return " ".join(self.by_id[i] for i in ids)


def _lower(text: str) -> str:
    """NFC, then each character in lower case by itself (str.lower() has a rule for last sigmas)."""
    if not text.isascii():
        text = normalize("NFC", text)
        if "Σ" in text:
            return "".join(c.lower() for c in text)
    return text.lower()


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


@lru_cache(maxsize=2)
def _memo(path: str) -> Memo:
    bpe = load(path)

    def shown(ids: list[int]) -> tuple[int, str, str]:
        return len(ids), " ".join(map(str, ids)), bpe.decode(ids)

    # Many more words than pieces are new: case, marks and specials make words of the same pieces.
    pieces = Memo(lambda piece: shown([bpe.ids[n] for n in bpe.tokens(piece)]))

    def make(word: str) -> tuple[int, str, str]:
        if "<|" in word:
            return shown(bpe.word_tokens(word))
        found = bpe.split(word)
        return pieces[found[0]] if len(found) == 1 else _joined(pieces.all(found))

    return Memo(make)


def _joined(found: list[tuple[int, str, str]]) -> tuple[int, str, str]:
    """What words or pieces gave, put together; those without a token leave no blank."""
    counts, ids, decoded = zip(*found) if found else ((), (), ())
    if 0 in counts:
        return _joined([f for f in found if f[0]])
    return sum(counts), " ".join(ids), " ".join(decoded)


def encode_words(text: str | None, path: str = WORD_BPE) -> list[int]:
    bpe = load(path)
    return [i for word in words_of(text or "") for i in bpe.word_tokens(word)]


def encode(
    docs: DataFrame, text: str = "text", key: str = "doc_id", path: str = WORD_BPE
) -> DataFrame:
    """``key`` and ``ids`` (array of int) of every whole text."""
    kind = docs.schema[key].dataType.simpleString()

    def make():
        return lambda keys, texts: {key: keys, "ids": [encode_words(t, path) for t in texts]}

    return map_rows(docs, [key, text], make, f"`{key}` {kind}, ids array<int>")


def decode(
    encoded: DataFrame, ids: str = "ids", key: str = "doc_id", path: str = WORD_BPE
) -> DataFrame:
    """``key`` and ``decoded`` of id lists; null ids give an empty text."""
    kind = encoded.schema[key].dataType.simpleString()

    def make():
        bpe = load(path)
        return lambda keys, lists: {key: keys, "decoded": [bpe.decode(x or []) for x in lists]}

    return map_rows(encoded, [key, ids], make, f"`{key}` {kind}, decoded string")


def round_trip(
    docs: DataFrame, text: str = "text", key: str = "doc_id", path: str = WORD_BPE
) -> DataFrame:
    """``key``, ``n_tokens``, ``ids_text`` (decimal ids joined by one space) and ``decoded``.

    Encodes and decodes in one pass. What a word gives is kept for its next use, within bounds.
    """
    kind = docs.schema[key].dataType.simpleString()

    def make():
        memo = _memo(path)

        def run(keys, texts):
            counts, ids, decoded = [], [], []
            for text in texts:
                n, i, d = _joined(memo.all(words_of(text)) if text else [])
                counts.append(n)
                ids.append(i)
                decoded.append(d)
            return {key: keys, "n_tokens": counts, "ids_text": ids, "decoded": decoded}

        return run

    schema = f"`{key}` {kind}, n_tokens bigint, ids_text string, decoded string"
    return map_rows(docs, [key, text], make, schema)
