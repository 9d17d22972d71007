"""BPE encoding by backtracking over Aho-Corasick matches, and decoding by an offset table.

The vocabulary is a public tokenizer file whose path is a parameter; nothing is trained.
Text is prepared as that file says (NFC, lower case, pieces by a pattern, bytes as
letters, an end mark on each piece). A piece is then encoded in linear time: one pass
of an Aho-Corasick automaton gives the longest token at every position; tokens are
taken greedily, each new one is checked against its predecessor with the pair
compatibility rule (would the merges ever join across this border?), and where no token
fits the last one is taken back and its next shorter prefix tried. Positions found to
be dead ends are marked, so none is entered twice. The result equals the ordered merges.

Defined results: null and empty text have no tokens; the two special strings of the
file become their ids as in the library; repeated rows are encoded each; further
columns are ignored by ``encode_documents``.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from survlake.llm.tables import ship, tidy

# White space as the tokenizer file's pattern engine has it.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"
SUFFIX = "</w>"
ROWS = 256  # documents whose ids are held at once
_MARK = "\n"  # stands for the suffix; it is not among the byte letters


def byte_letters() -> dict[int, str]:
    """Byte to letter: printable bytes stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def lower(text: str) -> str:
    """Lower case letter by letter (``str.lower`` treats a final capital sigma by its surroundings)."""
    return "σ".join(part.lower() for part in text.split("Σ")) if "Σ" in text else text.lower()


class Codec:
    """Encoder and decoder of one vocabulary file."""

    CACHE = 500_000  # pieces whose ids a worker remembers; beyond it the memory starts anew

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.base = len(vocab) - len(merges)
        names = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for name, i in chain(vocab.items(), self.special.items()):
            names[i] = name
        # decoding: one block of bytes and where each token starts in it
        coded = [n.encode() for n in names]
        self.block = b"".join(coded)
        self.offset = [0]
        for c in coded:
            self.offset.append(self.offset[-1] + len(c))
        self.decimal = [str(i).encode() for i in range(len(names))]
        self.surface = [block(n) for n in names[:len(vocab)]]
        ids = {s: i for i, s in enumerate(self.surface)}
        self.length = [len(s) for s in self.surface]
        self.left, self.right, self.pair = list(range(len(ids))), list(range(len(ids))), {}
        for rank, m in enumerate(merges):
            a, b = m if isinstance(m, list) else m.split(" ")
            i = self.base + rank
            if vocab[a + b] != i:
                raise ValueError("ids must follow the order of the merges")
            self.left[i], self.right[i] = vocab[a], vocab[b]
            self.pair[vocab[a], vocab[b]] = i
        self.shorter = [next((ids[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in ids), -1) for s in self.surface]
        self.machine = ahocorasick.Automaton()
        for s, i in ids.items():
            self.machine.add_word(s, i)
        self.machine.make_automaton()
        self.letters = {b: c for b, c in byte_letters().items()}
        self.split = regex.compile("|".join(map(regex.escape, self.special)))
        self.pieces = regex.compile(PIECES)
        self.known: dict[str, tuple[int, ...]] = {}
        self.fits: dict[tuple[int, int], bool] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges leave ``a`` and ``b`` side by side in the text of both.

        Undo the later of the two again and again: the parts at the border must never
        be a pair that merges before the part it belongs to was made.
        """
        if (known := self.fits.get((a, b))) is not None:
            return known
        x, y, made_by, ok = a, b, len(self.surface) + 1, None
        while ok is None:
            joined = self.pair.get((x, y))
            if joined is not None and joined < made_by:
                ok = False
            elif x > y and x >= self.base or y < self.base <= x:
                made_by, x = x, self.right[x]
            elif y >= self.base:
                made_by, y = y + 1, self.left[y]
            else:
                ok = True
        if len(self.fits) >= 1_000_000:
            self.fits.clear()
        self.fits[a, b] = ok
        return ok

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        found = self.known.get(piece)
        if found is None:
            word = "".join(map(self.letters.__getitem__, piece.encode("utf-8"))) + _MARK
            found = tuple(self._walk(word))
            if len(self.known) >= self.CACHE:
                self.known.clear()
            self.known[piece] = found
        return found

    def _walk(self, word: str) -> list[int]:
        n, length, shorter = len(word), self.length, self.shorter
        longest = [-1] * (n + 1)
        for end, i in self.machine.iter(word):
            at = end + 1 - length[i]
            if longest[at] < 0 or length[i] > length[longest[at]]:
                longest[at] = i
        alive = bytearray(b"\x01") * (n + 1)
        alive[n - 1] = 0  # the mark alone is no token
        taken: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            last = taken[-1] if taken else -1
            while token >= 0:
                end = at + length[token]
                if alive[end] and (last < 0 or self.compatible(last, token)):
                    break
                token = shorter[token]
            if token >= 0:
                taken.append(token)
                at = end
                token = longest[at]
            else:
                alive[at] = 0
                if not taken:
                    raise ValueError("the vocabulary can't spell this piece")
                token = taken.pop()
                at -= length[token]
        return taken

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        at = 0
        for m in self.split.finditer(text):
            self._plain(text[at:m.start()], ids)
            ids.append(self.special[m[0]])
            at = m.end()
        self._plain(text[at:] if at else text, ids)
        return ids

    def _plain(self, text: str, ids: list[int]) -> None:
        if text:
            if not text.isascii():
                text = unicodedata.normalize("NFC", text)
            known, one = self.known, self.encode_piece
            for piece in self.pieces.findall(lower(text)):
                ids.extend(known.get(piece) or one(piece))

    def token(self, i: int) -> bytes:
        return self.block[self.offset[i]:self.offset[i + 1]]

    def decode(self, ids: Iterable[int]) -> bytes:
        """UTF-8 of the tokens as the file names them, joined by one space: it has no decoder of its own."""
        block, offset = self.block, self.offset
        return b" ".join([block[offset[i]:offset[i + 1]] for i in ids])


def block(name: str) -> str:
    return name[:-len(SUFFIX)] + _MARK if name.endswith(SUFFIX) and len(name) > len(SUFFIX) else name


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec for each worker process and file."""
    return Codec(path)


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text",
                     with_ids: bool = False) -> DataFrame:
    """Encodes and decodes every whole text: key, ``n_tokens``, both digests, and the ids if asked for.

    ``path`` is read by each worker: a file that every executor has.
    """
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            n, ids_hex, text_hex, all_ids = [], [], [], []
            for value in b.column(1):
                ids = c.encode(value.as_py() or "")
                n.append(len(ids))
                ids_hex.append(hashlib.sha256(b" ".join([c.decimal[i] for i in ids])).hexdigest())
                text_hex.append(hashlib.sha256(c.decode(ids)).hexdigest())
                if with_ids:
                    all_ids.append(pa.array(ids, pa.int32()))
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())]
            if with_ids:
                ends = np.cumsum([0, *n]).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(all_ids)))
            yield pa.RecordBatch.from_arrays(
                cols,
                names=[key, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)

    return docs.select(key, text).mapInArrow(tidy(run), schema)
