"""Operator 1: SentencePiece BPE encoding by backtracking, and decoding.

A list of tokens is what merging yields exactly if each adjacent pair, merged again from characters, gives that pair.
So the encoder walks the text: at each place it takes the longest token (found by Aho-Corasick), shortens it while it
doesn't fit its left neighbour or ends at a place that is known to fail, and steps back a token when nothing is left,
marking the place as failed in a bitfield.

Edge cases: a null or empty text has no ids and decodes to ""; a character outside the vocabulary becomes its UTF-8
byte tokens; U+2581 in a text is a space, as in the library; control strings such as <s> are ordinary text.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import map_arrow, parts, to_batch

SPACE = "▁"
#: Distinct chunks, and pairs of tokens, that a worker remembers; beyond, it starts anew.
CACHE = 200_000


class Encoder:
    def __init__(self, model_file: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = self.library.get_piece_size()
        special = lambda i: self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i)
        self.ids = {self.library.id_to_piece(i): i for i in range(size) if not special(i)}
        self.score = {p: self.library.get_score(i) for p, i in self.ids.items()}
        self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = self.library.unk_id()
        #: the longest shorter token that a token starts with
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in self.ids), None) for p in self.ids}
        self.matcher = ahocorasick.Automaton()  # over reversed texts: a match that ends at i starts there in the text
        for p in self.ids:
            self.matcher.add_word(p[::-1], p)
        self.matcher.make_automaton()
        self.fits: dict[tuple[str, str], bool] = {}
        self.seen: dict[str, tuple[int, ...]] = {}
        self.split = _splitter(self.ids)

    def remerge(self, text: str) -> list[str]:
        """Plain BPE from characters: always the best-scored adjacent pair, the leftmost of equal ones."""
        parts: list[str | None] = list(text)
        after = [*range(1, len(parts)), -1]
        before = [-1, *range(len(parts) - 1)]
        queue: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (score := self.score.get(both := parts[i] + parts[j])) is not None:
                heapq.heappush(queue, (-score, i, j, both))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while queue:
            _, i, j, both = heapq.heappop(queue)
            if parts[i] is None or parts[j] is None or parts[i] + parts[j] != both or after[i] != j:
                continue
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in parts if p is not None]

    def compatible(self, left: str, right: str) -> bool:
        pair = (left, right)
        found = self.fits.get(pair)
        if found is None:
            if len(self.fits) > CACHE:
                self.fits.clear()
            found = self.fits[pair] = self.remerge(left + right) == [left, right]
        return found

    def tokens(self, text: str) -> list[str]:
        """The tokens of one chunk, by backtracking."""
        n = len(text)
        longest = list(text)  # a character outside the vocabulary is a token of its own
        for end, piece in self.matcher.iter(text[::-1]):
            start = n - 1 - end
            if len(piece) > len(longest[start]):
                longest[start] = piece
        failed = 0  # bitfield
        out: list[str] = []
        at, token = 0, longest[0] if n else None
        while at < n:
            end = at + len(token)
            if not failed >> end & 1 and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < n else None
                continue
            shorter = self.shorter.get(token)
            if shorter is None:
                failed |= 1 << at
                if not out:
                    raise AssertionError("no tokens yield this text")
                token = out.pop()
                at -= len(token)
            else:
                token = shorter
        return out

    def chunk_ids(self, chunk: str) -> tuple[int, ...]:
        out: list[int] = []
        for token in self.tokens(chunk):
            known = self.ids.get(token)
            if known is not None:
                out.append(known)
            elif self.bytes[0] != self.unknown:
                out += [self.bytes[b] for b in token.encode("utf-8", "surrogatepass")]
            else:
                out.append(self.unknown)
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        seen = self.seen
        for chunk in self.split((SPACE + text).replace(" ", SPACE)):
            ids = seen.get(chunk)
            if ids is None:
                if len(seen) >= CACHE:
                    seen.clear()
                ids = self.chunk_ids(chunk)
                if len(chunk) <= 64:
                    seen[chunk] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


def _splitter(pieces):
    """Cuts a text where no piece can span: merging never crosses such a place, so chunks are encoded on their own.

    The cuts are derived from the vocabulary: before a space mark if it only starts pieces, around newlines if no piece
    holds one, and between letters or digits and other characters, save near those that some piece has side by side.
    """
    if any(SPACE in p.lstrip(SPACE) for p in pieces) or any("\n" in p for p in pieces):
        return lambda text: [text]
    mixed = set()
    for p in pieces:
        p = p.lstrip(SPACE)
        for a, b in zip(p, p[1:]):
            if a.isalnum() != b.isalnum():
                mixed.add(a if a.isalnum() else b)
    coarse = re.compile(rf"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n").findall
    fine = re.compile(rf"{SPACE}*[^\W_]+|{SPACE}*(?:[^\w{SPACE}\n]|_)+|{SPACE}+|\n").findall  # \w is isalnum() or "_"
    if not mixed:
        return fine
    odd = re.compile(f"[{''.join(map(re.escape, sorted(mixed)))}]").search

    def split(text: str) -> list[str]:
        if odd(text) is None:
            return fine(text)
        return [part for whole in coarse(text) for part in ([whole] if odd(whole) else fine(whole))]

    return split


_ENCODERS: dict[str, Encoder] = {}


def encoder(model_file: str) -> Encoder:
    """One encoder for a model and process."""
    if model_file not in _ENCODERS:
        _ENCODERS[model_file] = Encoder(model_file)
    return _ENCODERS[model_file]


DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def encode_column(docs: DataFrame, model_file: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids array<int>, decoded string) of each row, nothing else of it."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model_file)
        for batch in parts(batches):
            ids = [enc.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([enc.decode(i) for i in ids], pa.string())], names=["doc_key", "ids", "decoded"])

    return map_arrow(docs.select(docs[key].alias("doc_key"), docs[text].alias("text")), run, f"doc_key {kind}, ids array<int>, decoded string").withColumnRenamed("doc_key", key)


def digests(docs: DataFrame, model_file: str) -> DataFrame:
    """Per document: n_tokens, SHA-256 of the decimal ids joined by commas, and of the decoded text."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model_file)
        name = [str(i) for i in range(enc.library.get_piece_size())].__getitem__
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in parts(batches):
            rows = [(len(i), sha(",".join(map(name, i))), sha(enc.decode(i))) for i in map(enc.encode, batch.column(1).to_pylist())]
            n, ids, decoded = zip(*rows) if rows else ((), (), ())
            yield to_batch({"doc_id": batch.column(0), "n_tokens": n, "ids_sha256": ids, "decoded_sha256": decoded}, schema)

    return map_arrow(docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"]), run, DIGESTS)


def encoded(docs: DataFrame, model_file: str) -> DataFrame:
    """Per document: doc_id, lang, source, n_tokens, ids, and the two digests: ready for training or for checking."""
    kinds = [(c, docs.schema[c].dataType.simpleString()) for c in ("doc_id", "lang", "source")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model_file)
        name = [str(i) for i in range(enc.library.get_piece_size())].__getitem__
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in parts(batches):
            ids = [enc.encode(t) for t in batch.column(3).to_pylist()]
            new = [pa.array([len(i) for i in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([sha(",".join(map(name, i))) for i in ids]), pa.array([sha(enc.decode(i)) for i in ids])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *new], names=["doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    schema = ", ".join(f"{c} {k}" for c, k in kinds) + ", n_tokens bigint, ids array<int>, ids_sha256 string, decoded_sha256 string"
    return map_arrow(docs.select("doc_id", "lang", "source", "text"), run, schema)
