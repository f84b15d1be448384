"""Operator 10: byte-pair encoding by per-prefix dynamic programming, and decoding.

For every prefix of a pre-token there is exactly one token that can end its encoding. The suffix automaton of the
vocabulary gives the tokens that end at each position; the one whose left neighbour (the stored last token of the
shorter prefix) is *compatible* with it is stored, and back-pointers from the end emit the ids. Two tokens are
compatible when no merge across their boundary would have fired before the merges that made them. The cost is linear
in the text, however long a pre-token is.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import map_rows, small_batches, table, tidy

#: White_Space code points, and the letters and numbers below U+02B0, as the pre-tokenizer's pattern means them.
SPACE = "\t-\r \x85\xa0  -     　"
LOW_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ʯ"
LOW_NUMBERS = "0-9²³¹¼-¾"
#: Distinct pre-tokens whose encoding a Python worker keeps; beyond it the store starts anew (results do not depend on it).
KEEP = 300_000


def byte_characters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _pattern(engine, letters: str, numbers: str):
    w = SPACE
    return engine.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{w}{letters}{numbers}]+|[{w}]+(?![^{w}])|[{w}]+")


class SuffixAutomaton:
    """The suffix automaton of all tokens: a state stands for the parts of tokens that occur at the same places.

    Reading a text, the state and a length say which is the longest end of what was read that is part of some token.
    The tokens among the ends of a state are its own (``ends``, longest first) and those of the states along suffix links;
    ``longest`` is the longest of them, and ``shorter`` leads from a token to the next shorter one that it ends with.
    """

    def __init__(self, tokens: dict[bytes, int]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for raw in tokens:
            last = 0
            for byte in raw:
                last = self._extend(last, byte)
        self.width = {i: len(raw) for raw, i in tokens.items()}
        self.ends: dict[int, list[int]] = {}
        for raw, i in sorted(tokens.items(), key=lambda x: -len(x[0])):
            state = 0
            for byte in raw:
                state = self.next[state][byte]
            self.ends.setdefault(state, []).append(i)
        self.longest = [-1] * len(self.link)
        self.shorter: dict[int, int] = {}
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            below = self.longest[self.link[state]]
            chain = [*self.ends.get(state, []), below]
            self.longest[state] = chain[0]
            self.shorter.update(zip(chain, chain[1:], strict=False))

    def _copy(self, state: int, length: int) -> int:
        """Split off from ``state`` its strings of at most ``length`` signs."""
        self.next.append(dict(self.next[state]))
        self.link.append(self.link[state])
        self.length.append(length)
        self.link[state] = len(self.link) - 1
        return self.link[state]

    def _target(self, state: int, byte: int) -> int:
        """Where ``byte`` leads from ``state``, split if that holds longer strings than one more sign makes."""
        old = self.next[state][byte]
        if self.length[old] == self.length[state] + 1:
            return old
        new = self._copy(old, self.length[state] + 1)
        while state >= 0 and self.next[state].get(byte) == old:
            self.next[state][byte] = new
            state = self.link[state]
        return new

    def _extend(self, last: int, byte: int) -> int:
        if byte in self.next[last]:
            return self._target(last, byte)
        new = len(self.link)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        while last >= 0 and byte not in self.next[last]:
            self.next[last][byte] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._target(last, byte)
        return new

    def matches(self, raw: bytes) -> list[int]:
        """The longest token that ends at each byte (-1 if none does)."""
        steps, link, length, longest, ends, width = self.next, self.link, self.length, self.longest, self.ends, self.width
        state = held = 0
        out = []
        for byte in raw:
            while byte not in steps[state] and state:
                state = link[state]
                held = length[state]
            if byte in steps[state]:
                state = steps[state][byte]
                held += 1
            token = longest[state]
            if held < length[state] and state in ends:
                # Of the state's own tokens only those count that are no longer than what was read.
                token = next((t for t in ends[state] if width[t] <= held), longest[link[state]])
            out.append(token)
        return out


class PrefixBpe:
    """Encoder and decoder of one byte-level BPE vocabulary file (the ``tokenizers`` JSON format)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only plain byte-level BPE files are supported")
        chars = byte_characters()
        vocab = spec["model"]["vocab"]
        self.piece = {i: bytes(chars[c] for c in s) for s, i in vocab.items() if all(c in chars for c in s)}
        ids = {s: i for s, i in vocab.items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.birth: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for r, (a, b) in enumerate(merges):
            x, y, z = ids[a], ids[b], ids[a + b]
            self.rank.setdefault(x << 20 | y, r)
            if z not in self.birth:
                self.birth[z], self.halves[z] = r, (x, y)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special_bytes = {i: s.encode() for s, i in self.special.items()}
        self.compatible: dict[int, bool] = {}
        self.single = {self.piece[i]: i for i in self.piece if len(self.piece[i]) == 1}
        sound: dict[int, bool] = {}
        self.suffixes = SuffixAutomaton({raw: i for i, raw in self.piece.items() if i not in self.special_bytes and self._sound(i, sound)})
        self.low = _pattern(re, LOW_LETTERS, LOW_NUMBERS)
        self.any = _pattern(regex, r"\p{L}", r"\p{N}")
        self.beyond = re.compile("[ʰ-\U0010ffff]")
        self.cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.bytes_of = self.piece | self.special_bytes
        self.known: dict[str, str] = {}

    def _sound(self, token: int, seen: dict[int, bool]) -> bool:
        """Whether the merges turn the token's own bytes into it."""
        if token not in seen:
            if token not in self.halves:
                seen[token] = len(self.piece[token]) == 1
            else:
                x, y = self.halves[token]
                seen[token] = self._sound(x, seen) and self._sound(y, seen) and self._stays_apart(x, y, self.birth[token])
        return seen[token]

    def _stays_apart(self, left: int, right: int, until: int | None = None) -> bool:
        """Whether no merge joins bytes of ``left`` and ``right`` (before rank ``until``, if given).

        Time runs backwards from the finished tokens: the half that was made last is taken apart first (of equal
        ranks the right one, since merges of one rank run from left to right), and at each moment the pair that then
        touched the boundary must not have a merge that comes before the next step of its own side.
        """
        x, y = left, right
        x_end = y_end = 1 << 40 if until is None else until
        birth, rank, halves = self.birth, self.rank, self.halves
        while True:
            r = rank.get(x << 20 | y)
            if r is not None and r < x_end and r <= y_end and (until is None or r < until):
                return False
            bx, by = birth.get(x, -1), birth.get(y, -1)
            if bx < 0 and by < 0:
                return True
            if by >= bx:
                y_end, y = by, halves[y][0]
            else:
                x_end, x = bx, halves[x][1]

    def encode_piece(self, raw: bytes) -> list[int]:
        """Ids of one pre-token."""
        shorter, width, compatible = self.suffixes.shorter, self.suffixes.width, self.compatible
        last = [-1]
        for end, token in enumerate(self.suffixes.matches(raw), 1):
            while True:
                start = end - width[token]
                if not start:
                    break
                pair = last[start] << 20 | token
                ok = compatible.get(pair)
                if ok is None:
                    if len(compatible) > 500_000:
                        compatible.clear()
                    ok = compatible[pair] = self._stays_apart(last[start], token)
                if ok:
                    break
                token = shorter[token]
            last.append(token)
        end = len(raw)
        out = []
        while end:
            out.append(last[end])
            end -= width[last[end]]
        return out[::-1]

    def _pieces(self, text: str) -> list[str]:
        return (self.any if self.beyond.search(text) else self.low).findall(text)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for i, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if i % 2:
                out.append(self.special[part])
            else:
                for p in self._pieces(part):
                    out += self.encode_piece(p.encode())
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def _shown(self, piece: str) -> str:
        """The decimal ids of a pre-token or special token, joined by commas; kept for the next time it comes."""
        if len(self.known) >= KEEP:
            self.known.clear()
        ids = [self.special[piece]] if piece in self.special else self.encode_piece(piece.encode())
        shown = self.known[piece] = ",".join(map(str, ids))
        return shown

    def encode_batch(self, texts: list[str]) -> tuple[pa.Array, pa.Array]:
        """For each text the decimal ids joined by commas, and the decoded bytes.

        Each distinct pre-token of the batch is encoded, and its ids decoded, once; the rest is Arrow kernels.
        """
        pieces: list[str] = []
        offsets = [0]
        for text in texts:
            for i, part in enumerate(self.cut.split(text) if self.cut else [text]):
                if i % 2:
                    pieces.append(part)
                else:
                    pieces += self._pieces(part)
            offsets.append(len(pieces))
        coded = pa.array(pieces, pa.string()).dictionary_encode()
        del pieces
        known, make = self.known, self._shown
        shown = [known.get(p) or make(p) for p in coded.dictionary.to_pylist()]
        raw = [b"".join([self.bytes_of[int(i)] for i in s.split(",")]) for s in shown]
        spans = pa.array(offsets, pa.int32())
        take = lambda values, kind: pc.binary_join(pa.ListArray.from_arrays(spans, pa.array(values, kind).take(coded.indices)), pa.scalar("," if kind == pa.string() else b"", kind))
        return take(shown, pa.string()), take(raw, pa.binary())

    def ids_of(self, text: str) -> list[int]:
        return [int(i) for i in self.encode_batch([text])[0][0].as_py().split(",") if i]

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """For each text: number of ids, SHA-256 of the ids joined by commas, SHA-256 of the decoded text."""
        out = []
        for shown, raw in zip(*self.encode_batch(texts), strict=True):
            ids, back = shown.as_py().encode(), raw.as_py().decode("utf-8", "replace").encode()
            out.append((ids.count(b",") + 1 if ids else 0, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()))
        return out


_LOADED: dict[str, PrefixBpe] = {}


def load(path: str) -> PrefixBpe:
    """One encoder per path and Python worker."""
    if path not in _LOADED:
        _LOADED[path] = PrefixBpe(path)
    return _LOADED[path]


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Encode:
    factory = True

    def __init__(self, path: str):
        self.path = path

    def __call__(self):
        coder = load(self.path)
        return lambda text: (coder.ids_of(text or ""),)


class _Decode:
    factory = True

    def __init__(self, path: str):
        self.path = path

    def __call__(self):
        coder = load(self.path)
        return lambda ids: (coder.decode([i for i in ids or [] if i is not None]),)


def encode(docs: DataFrame, path: str | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "token_ids") -> DataFrame:
    """``keep`` columns and the token ids of each text (array<int>). Null and empty texts give an empty array; rows are independent, so repeated rows and ids stay."""
    return map_rows(docs, _Encode(path or vocabulary_path()), [T.StructField(out, T.ArrayType(T.IntegerType()))], list(keep), [text])


def decode(tokens: DataFrame, path: str | None = None, ids: str = "token_ids", keep: tuple[str, ...] = ("doc_id",), out: str = "text") -> DataFrame:
    """The text of each id array; null gives the empty text."""
    return map_rows(tokens, _Decode(path or vocabulary_path()), [T.StructField(out, T.StringType())], list(keep), [ids])


DIGEST_FIELDS = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]


class _Digests:
    """Arrow batches of (doc_id, text) to (doc_id, digests)."""

    def __init__(self, path: str):
        self.path = path

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(self.path)
        for batch in batches:
            for part in small_batches(batch, 1 << 20):
                rows = coder.digests([t or "" for t in part.column(1).to_pylist()])
                n, ids, back = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=["doc_id", *(f.name for f in DIGEST_FIELDS)])


def token_digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document; a null text counts as empty, columns besides doc_id and text are ignored."""
    slim = docs.select("doc_id", "text")
    return slim.mapInArrow(tidy(_Digests(path or vocabulary_path())), T.StructType([slim.schema["doc_id"], *DIGEST_FIELDS]))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(table(spark, sf_dir, "documents"))
