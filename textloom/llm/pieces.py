"""SentencePiece encoding and decoding with a given model, by shared-prefix Viterbi.

A text, after its dummy prefix space, falls into marked words: runs of spaces with what follows them up to the next space
or line feed.  The distinct words of many texts are sorted, which lays them out as a trie in depth-first order, and are
encoded one after another on a stack of forward states, one for each character: what a word has in common with the one
before it is never computed again.

The forward state of a prefix depends on the model's kind.  For a unigram model it is the best score of the prefix and the
piece with which it ends.  For a BPE model the encoding of a prefix is unique and ends with one piece; that is the one
piece which is compatible with the last piece of the prefix before it, two pieces being compatible if merging their
concatenation by rank gives back the two.  So the same recursion gives exactly what merging gives.

The pieces with which a prefix may end follow from its longest end that begins a piece.  These ends are nodes, found when a
text first has them; a step leads from a node and a character to the next one.  Two pieces are compatible if nothing is
merged across their border while each side is merged as it would be alone, so a piece's own merges are found once.

Characters without a piece become the pieces of their UTF-8 bytes.  Encoding is reversible: U+2581 in a text, which a
model takes for a space, goes by its bytes.  ``decode`` gives back the text.

Defined results: a null or empty text has no pieces; repeated rows are encoded each; other columns are kept; an empty
table gives no row.  A task keeps the words it has encoded, about ``keep`` bytes of them at most, then starts anew; a
worker keeps a bounded number of steps and answers about two pieces for its next tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from textloom.llm.words import slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_MARK = "▁"
_NEVER = float("-inf")


@dataclass
class Vocabulary:
    """Pieces with spaces for marks; ids of bytes; whether merging by rank (BPE) or the best sum of scores counts."""

    ids: dict[str, int]
    scores: dict[str, float]
    bytes_: list[int]
    merges: bool
    dummy_prefix: bool
    texts: list[bytes]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        model.ParseFromString(SentencePieceProcessor(model_file=path).serialized_model_proto())
        if model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("models that change texts before encoding can't be reversed")
        ids, scores, bytes_, texts = {}, {}, [0] * 256, []
        for i, p in enumerate(model.pieces):
            if p.type == 6:
                bytes_[int(p.piece[3:-1], 16)] = i
                texts.append(bytes([int(p.piece[3:-1], 16)]))
            elif p.type in (1, 4):
                ids[p.piece.replace(_MARK, " ")] = i
                scores[p.piece.replace(_MARK, " ")] = p.score
                texts.append(p.piece.replace(_MARK, " ").encode())
            else:
                texts.append(b"")
        return cls(ids, scores, bytes_, model.trainer_spec.model_type == 2, model.normalizer_spec.add_dummy_prefix, texts)

    @cached_property
    def encoder(self) -> Encoder:
        """One for all tasks of a worker: it keeps the broadcast value, and with it what was found out about pieces."""
        return Encoder(self)


class _Node:
    """The longest end of a prefix that begins a piece; ``ends``: the pieces with which the prefix may end, longest first.

    Each is (length, piece, its id as 4 bytes, the pieces before it that were asked for: whether it follows).
    """

    __slots__ = ("text", "ends", "next")

    def __init__(self, text: str, ends: list[tuple[int, str, bytes, dict[str | None, bool]]]):
        self.text, self.ends = text, ends
        self.next: dict[str, _Node] = {}


class Encoder:
    def __init__(self, v: Vocabulary, most: int = 500_000):
        self.v = v
        self.most = most  # so many steps between nodes and answers about two pieces are kept; others are found anew each time
        self.begins = {p[:k] for p in v.ids for k in range(len(p) + 1)} | {""}
        self.coded = {p: i.to_bytes(4, "little") for p, i in v.ids.items()}
        self.split = re.compile(r"\n| +[^ \n]*|[^ \n]+" if not any("\n" in p for p in v.ids) else r" +[^ ]*|[^ ]+")
        if any(" " in p.lstrip(" ") for p in v.ids):
            self.split = re.compile(r"(?s).+")  # pieces that span words: a text is one word
        self.mergings: dict[str, tuple[list[tuple[float, str]], list[tuple[float, str]]] | None] = {}  # of pieces: as many as the model has
        self.forget()

    def forget(self) -> None:
        """Drop what was found out about pieces so far."""
        self.nodes: dict[str, _Node] = {}
        self.follows: dict[str, dict[str | None, bool]] = {}
        self.kept = 0

    def _merging(self, piece: str) -> tuple[list[tuple[float, str]], list[tuple[float, str]]] | None:
        """How merging by rank, leftmost first among equals, makes a piece of its characters; None if it doesn't.

        For each merge its score with the first part that there was before it, and with the last; at the end comes no merge.
        """
        if piece not in self.mergings:
            parts, scores, first, last = list(piece), self.v.scores, [], []
            ranks = [scores.get(a + b, _NEVER) for a, b in zip(parts, parts[1:], strict=False)]
            while True:
                best = max(ranks, default=_NEVER)
                first.append((best, parts[0])), last.append((best, parts[-1]))
                if best == _NEVER:
                    break
                i = ranks.index(best)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                del ranks[i]
                if i:
                    ranks[i - 1] = scores.get(parts[i - 1] + parts[i], _NEVER)
                if i < len(ranks):
                    ranks[i] = scores.get(parts[i] + parts[i + 1], _NEVER)
            self.mergings[piece] = (first, last) if len(parts) == 1 else None
        return self.mergings[piece]

    def apart(self, before: str, piece: str) -> bool:
        """Whether merging two pieces' characters gives back the two: each side goes its own way as long as nothing is merged across."""
        left, right, scores = self._merging(before), self._merging(piece), self.v.scores
        if left is None or right is None:
            return False
        ends, begins = iter(left[1]), iter(right[0])
        (mine, end), (other, begin) = next(ends), next(begins)
        while True:
            across = scores.get(end + begin, _NEVER)
            if across > mine and across >= other:
                return False
            if mine == other == _NEVER:
                return True
            if mine >= other:
                mine, end = next(ends)
            else:
                other, begin = next(begins)

    def _follows(self, before: str | None, piece: str) -> bool:
        ok = self._merging(piece) is not None if before is None else self.apart(before, piece)
        if self.kept < self.most:
            self.follows[piece][before] = ok
            self.kept += 1
        return ok

    def _node(self, text: str) -> _Node:
        node = self.nodes.get(text)
        if node is None:
            ends = [text[i:] for i in range(len(text)) if text[i:] in self.v.ids]
            node = self.nodes[text] = _Node(text, [(len(p), p, self.coded[p], self.follows.setdefault(p, {})) for p in ends])
        return node

    def _step(self, node: _Node, char: str) -> _Node:
        text = node.text + char
        while text not in self.begins:
            text = text[1:]
        to = self._node(text)
        if self.kept < self.most:
            node.next[char] = to
            self.kept += 1
        return to

    def encode_sorted(self, words: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        """(word, ids as 4-byte integers) of sorted words, each beginning with the states of the prefix it shares.

        A state is the last piece, its length, its ids, the score and the node of what isn't over yet: memory grows with a
        word's length, not with its square.
        """
        merges, scores, bytes_ = self.v.merges, self.v.scores, self.v.bytes_
        last: list[str | None] = [None]  # the piece that ends each prefix; None where bytes do, or at the start
        size, coded, total, nodes = [0], [b""], [0.0], [self._node("")]
        earlier = ""
        for word in words:
            n = 0
            for a, b in zip(word, earlier):
                if a != b:
                    break
                n += 1
            del last[n + 1 :], size[n + 1 :], coded[n + 1 :], total[n + 1 :], nodes[n + 1 :]
            node = nodes[n]
            for char in word[n:]:
                node = node.next.get(char) or self._step(node, char)
                nodes.append(node)
                found = None
                if merges:
                    for k, piece, ids, follows in node.ends:
                        before = last[-k]
                        ok = follows.get(before)
                        if self._follows(before, piece) if ok is None else ok:
                            found = piece
                            break
                else:
                    best = -1e300
                    for k_, piece, ids_, _ in node.ends:
                        if total[-k_] + scores[piece] > best:
                            found, best, k, ids = piece, total[-k_] + scores[piece], k_, ids_
                    total.append(total[-1] - 1e6 if found is None else best)
                if found is None:
                    k, ids = 1, b"".join(bytes_[b].to_bytes(4, "little") for b in char.encode())
                last.append(found), size.append(k), coded.append(ids)
            earlier, end, path = word, len(word), []
            while end:
                path.append(coded[end])
                end -= size[end]
            path.reverse()
            yield word, b"".join(path)

    def words(self, text: str) -> list[str]:
        return self.split.findall((" " if self.v.dummy_prefix else "") + text) if text else []

    def decode(self, ids: Iterable[int]) -> str:
        data = b"".join(map(self.v.texts.__getitem__, ids)).decode("utf-8", "replace")
        return data[1:] if self.v.dummy_prefix and data[:1] == " " else data


def _encoded(sent, keep: int, others: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, known, size = sent.value.encoder, {}, 0
        for part in slices(batches, "text"):
            texts = [x or "" for x in part.column("text").to_pylist()]
            words = [encoder.words(x) for x in texts]
            if encoder.kept >= encoder.most:
                encoder.forget()
            new = {w for w in set().union(*words) if w not in known}
            if size + sum(map(len, new)) + 50 * len(new) > keep:
                known.clear()
                new, size = set().union(*words), 0
            size += sum(map(len, new)) + 50 * len(new)
            known.update(encoder.encode_sorted(sorted(new)))
            data = [b"".join(map(known.__getitem__, ws)) for ws in words]
            ids = np.frombuffer(b"".join(data), np.int32)
            at = np.concatenate([[0], np.cumsum([len(d) // 4 for d in data])]).astype(np.int32)
            flat = ids.tolist()
            same = [encoder.decode(flat[a:b]) == x for a, b, x in zip(at[:-1].tolist(), at[1:].tolist(), texts, strict=True)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), pa.array(np.diff(at).astype(np.int64)), pa.ListArray.from_arrays(pa.array(at), pa.array(ids)), pa.array(same)], names=[*others, "n_pieces", "ids", "round_trip"])

    return run


def encode(docs: DataFrame, model: str = MODEL, keep: int = 24_000_000, text: bool = False) -> DataFrame:
    """The columns of docs (the text only if asked for), n_pieces, ids, and whether decoding the ids gives the text back."""
    sent = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))  # a fixed size, the model's
    docs = docs.drop("n_pieces", "ids", "round_trip")
    others = [f for f in docs.schema if text or f.name != "text"]
    schema = T.StructType([*others, T.StructField("n_pieces", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())])
    return docs.mapInArrow(_encoded(sent, keep, [f.name for f in others]), schema)


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """encoded with a column ``text`` decoded from ``ids``; null ids give an empty text."""
    sent = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    encoded = encoded.drop("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = sent.value.encoder
        for batch in batches:
            texts = [encoder.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema, T.StructField("text", T.StringType())]))
