"""BPE encoding by per-prefix dynamic programming, and decoding.

For every prefix of a word there is exactly one token that can end its encoding.
An automaton over the vocabulary lists the tokens that are suffixes of each
prefix; the one that may follow the encoding of what stands before it (a test on
two adjacent tokens) is stored, and back-pointers from the whole word give the
ids. The test replays in reverse the merges along the seam of the two tokens: the
pair is compatible if no merge across the seam would have come before the merges
that built them.

Splitting of text into words follows the tokenizer file; pieces of Latin letters
take a plain pattern, others the file's own normaliser and pre-tokeniser.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text, text_or_empty

_END = "</w>"
_MARK = "\x00"
_FAR = 1 << 60
_STOPS = frozenset(".,;:!?")
#: Entries of a worker's memo of pieces, then of compatible pairs; beyond them the memo starts anew.
MEMO_PIECES, MEMO_PAIRS = 500_000, 600_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(other)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of one tokenizer file with end-of-word tokens."""

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.library = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.rank = [-1] * size
        self.left, self.right = [-1] * size, [-1] * size
        self.merge: dict[tuple[int, int], int] = {}
        usable = [False] * size
        for text, i in vocab.items():
            usable[i] = len(text.removesuffix(_END)) == 1
        for k, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.merge.setdefault((x, y), k)
            if self.rank[z] < 0:
                self.rank[z], self.left[z], self.right[z] = k, x, y
                usable[z] = usable[x] and usable[y] and self._seam_holds(x, y, k)
        self.automaton = ahocorasick.Automaton()
        for text, i in vocab.items():
            if usable[i]:
                key = text.removesuffix(_END) + _MARK if text.endswith(_END) else text
                self.automaton.add_word(key, (i, len(key)))
        self.automaton.make_automaton()
        self.text_of = [None] * size
        for text, i in [*vocab.items(), *self.special.items()]:
            self.text_of[i] = text
        letters = _byte_letters()
        self.letter_map = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(0x250)}
        # letters that normalisation leaves alone and that have one lower-case letter: Latin up to U+024F but U+0130
        self.simple = re.compile(r"[\x00-\x7f\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u024f]*").fullmatch
        latin = r"a-z\xdf-\xf6\xf8-\u024f"
        self.simple_words = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{latin}]+|[0-9]|[^{latin}0-9\t-\r ]+").findall
        self.pieces: dict[bytes, tuple[int, ...]] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[int, bool] = {}

    def _seam_holds(self, a: int, b: int, below: int = _FAR) -> bool:
        """Whether no merge of a rank under `below` joins the two sides before their own merges do."""
        rank, merge = self.rank, self.merge
        up_a = up_b = below
        while True:
            m = merge.get((a, b))
            # of equal merges the leftmost comes first: it is the left side's own, or the one across
            if m is not None and m < up_a and (m <= up_b if up_b != below else m < up_b):
                return False
            if rank[a] < 0 and rank[b] < 0:
                return True
            if rank[a] > rank[b]:
                up_a, a = rank[a], self.right[a]
            else:
                up_b, b = rank[b], self.left[b]

    def compatible(self, a: int, b: int) -> bool:
        if len(self.pairs) >= MEMO_PAIRS:
            self.pairs.clear()
        known = self.pairs[a << 20 | b] = self._seam_holds(a, b)
        return known

    def encode_word(self, word: str) -> tuple[int, ...]:
        """Ids of one word of byte letters (without the end mark)."""
        n = len(word) + 1
        last, back = [-1] * n, [0] * n  # of the prefix that ends with each letter
        pairs, compatible = self.pairs.get, self.compatible
        for end, token, start in [(e, t, e - k) for e, (t, k) in self.automaton.iter(word + _MARK)]:
            if last[end] < 0:
                if start < 0:
                    last[end], back[end] = token, -1
                elif (before := last[start]) >= 0:
                    fits = pairs(before << 20 | token)
                    if fits or fits is None and compatible(before, token):
                        last[end], back[end] = token, start
        ids, end = [], n - 1
        while end >= 0:
            ids.append(last[end])
            end = back[end]
        return tuple(ids[::-1])

    def _word(self, word: str) -> tuple[int, ...]:
        if len(self.words) >= MEMO_PIECES:
            self.words.clear()
        known = self.words[word] = self.encode_word(word.translate(self.letter_map))
        return known

    def _plain(self, text: str) -> list[int]:
        if self.simple(text):
            known, ids = self.words.get, []
            if text.isalpha():
                word = text.lower()
                return known(word) or self._word(word)
            if text[-1:] in _STOPS and text[:-1].isalpha():
                word, stop = text[:-1].lower(), text[-1]
                return (known(word) or self._word(word)) + (known(stop) or self._word(stop))
            for w in self.simple_words(text.lower()):
                ids += known(w) or self._word(w)
            return ids
        clean = self.library.normalizer.normalize_str(text)
        return [i for w, _ in self.library.pre_tokenizer.pre_tokenize_str(clean) for i in self.encode_word(w)]

    def piece(self, piece: bytes) -> tuple[int, ...]:
        """Ids of a run of text without ASCII white space."""
        text = piece.decode("utf-8", "surrogatepass")
        if self.split_special is None or "<|" not in text:
            ids = self._plain(text)
        else:
            ids = []
            for k, part in enumerate(self.split_special.split(text)):
                ids += [self.special[part]] if k % 2 else self._plain(part)
        if len(self.pieces) >= MEMO_PIECES:
            self.pieces.clear()
        self.pieces[piece] = got = tuple(ids)
        return got

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text. White space only separates words here, so pieces between
        ASCII white space (no letter composes across it) are encoded by themselves."""
        known, ids = self.pieces.get, []
        for piece in text.encode("utf-8", "surrogatepass").split():
            ids += known(piece) or self.piece(piece)
        return ids

    def decode(self, ids: list[int]) -> str:
        """Token texts with a space between them; ids outside the vocabulary are left out."""
        text_of = self.text_of
        try:
            return " ".join(map(text_of.__getitem__, ids))
        except (IndexError, TypeError):
            return " ".join(text_of[i] for i in ids if 0 <= i < len(text_of) and text_of[i] is not None)


@lru_cache(maxsize=2)
def _loaded(path: str) -> WordBpe:
    return WordBpe(path)


def encode(docs: DataFrame, path: str | None = None, decoded: bool = False) -> DataFrame:
    """One row per row of `docs`: doc_id, ids array<int>, and with `decoded` the decoded text.

    A null text counts as empty and gives no ids; other columns of `docs` are not
    read. Rows repeat as given. Narrow: no shuffle, and a worker holds one slice of
    rows and two bounded memos.
    """
    path = path or default_tokenizer()

    def run(texts: list) -> dict[str, list]:
        bpe = _loaded(path)
        ids = [bpe.encode(t) for t in texts]
        return {"ids": ids} | ({"decoded": [bpe.decode(x) for x in ids]} if decoded else {})

    source = docs.select("doc_id", text_or_empty().alias("text"))
    return map_text(source, run, "ids array<int>" + (", decoded string" if decoded else ""), rows=500)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and decoded text of doc_id, ids; null ids decode to an empty text."""
    path = path or default_tokenizer()

    def run(rows: list) -> dict[str, list]:
        bpe = _loaded(path)
        return {"decoded": [bpe.decode(x or []) for x in rows]}

    return map_text(encoded.select("doc_id", "ids"), run, "decoded string", rows=500)


def digests(encoded: DataFrame) -> DataFrame:
    """Counts and digests of `encode(..., decoded=True)`."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
