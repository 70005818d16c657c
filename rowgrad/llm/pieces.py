"""Subword encoding and decoding with a given SentencePiece vocabulary.

Texts are cut where no piece can reach across. In each slice of rows the distinct marked words are sorted, so that going through them is a
depth-first walk of their trie: the forward states of the prefix that a word shares with the one before are taken over. A state holds the best last
piece of a prefix; a piece may follow another only if merging would leave the two apart, which makes the
path the one that the vocabulary's merges give, token for token.
"""

from __future__ import annotations

import heapq
import re
from array import array
from itertools import chain
from string import digits, punctuation

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rowgrad.llm.texts import Remembered, opened, over_texts, share, slices

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def cuts(pieces: list[str]) -> re.Pattern:
    """Pattern of words: runs of letters or of marks with the spaces before them, line ends, spaces.

    Marks are the vocabulary's characters that are no letters and that no piece joins to anything but marks, so that no merge reaches from one
    word into the next.
    """
    pairs = {(x, y) for p in pieces for x, y in zip(p, p[1:]) if x != " "}
    marks = set(punctuation + digits)
    # other marks that a piece joins to these belong to them; a mark that a piece joins to a letter is cut off from nothing
    while more := {c for x, y in pairs if (x in marks) != (y in marks) for c in (x, y) if c not in marks and not c.isalpha()}:
        marks |= more
    while joined := {c for x, y in pairs if (x in marks) != (y in marks) for c in (x, y) if c in marks}:
        marks -= joined
    some = "".join(map(re.escape, sorted(marks)))
    return re.compile(rf" *(?:[{some}]+|[^ \n{some}]+)|\n| +" if some else r" *[^ \n]+|\n| +")


class Vocabulary:
    """Ranks and ids of pieces by their text with plain spaces; 256 ids for bytes."""

    def __init__(self, path: str = VOCABULARY):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.ids = {model.id_to_piece(i).replace("▁", " "): i for i in plain}
        self.cost = {model.id_to_piece(i).replace("▁", " "): -model.get_score(i) for i in plain}
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.cut = cuts(list(self.ids)).pattern
        self.n = n

    def table(self) -> list[bytes]:
        """What each id stands for."""
        out = [b""] * self.n
        for piece, i in self.ids.items():
            out[i] = piece.encode()
        for b, i in enumerate(self.bytes):
            out[i] = bytes([b])
        return out


# Texts whose words are sorted together: the more, the more prefixes they share.
SORTED_BYTES = 4 << 20


class Encoder:
    """Encodes sorted words, keeping forward states along the current path of the trie."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.parts: dict[str, tuple[str, str] | None] = {}
        self.apart = Remembered(None, 200_000)
        self.sides: dict[tuple[str, int], list[tuple[str, float, float]]] = {}
        self.cut = re.compile(vocabulary.cut)
        self.tails = {p[i:] for p in vocabulary.cost for i in range(len(p))}
        self.path, self.last = "", [""]

    def merged(self, text: str) -> list[str]:
        """Pieces by merging: always the cheapest neighbours, the leftmost of equal ones."""
        cost, parts = self.v.cost, list(text)
        after, before = [*range(1, len(parts)), -1], [*range(-1, len(parts) - 1)]
        heap = [(cost[p], i, p) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in cost]
        heapq.heapify(heap)
        while heap:
            _, i, p = heapq.heappop(heap)
            j = after[i]
            if j < 0 or not parts[i] or parts[i] + parts[j] != p:
                continue
            parts[i], parts[j] = p, ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
                if (q := p + parts[after[j]]) in cost:
                    heapq.heappush(heap, (cost[q], i, q))
            after[j] = -1
            if before[i] >= 0 and (q := parts[before[i]] + p) in cost:
                heapq.heappush(heap, (cost[q], before[i], q))
        return [p for p in parts if p]

    def halves(self, piece: str) -> tuple[str, str] | None:
        """The last merge that makes a piece; None for one character and for what merging never makes."""
        if piece not in self.parts:
            found = None
            if len(piece) > 1:
                held = self.v.cost.pop(piece)
                two = self.merged(piece)
                self.v.cost[piece] = held
                found = (two[0], two[1]) if len(two) == 2 else None
            self.parts[piece] = found
        return self.parts[piece]

    def side(self, piece: str, right: int) -> list[tuple[str, float, float]]:
        """The parts at one end of a piece, largest first, with the costs of the merge that makes each and of the one that swallows it."""
        if (piece, right) not in self.sides:
            cost, found, part, ends = self.v.cost, [], piece, float("inf")
            while (two := self.halves(part)) is not None:
                found.append((part, cost[part], ends))
                part, ends = two[right], cost[part]
            self.sides[piece, right] = [*found, (part, -1.0, ends)]
        return self.sides[piece, right]

    def may_follow(self, a: str, b: str) -> bool:
        """Do both pieces stay as they are when merged side by side?

        They don't if some right part of a and some left part of b, which stand next to each other at some time, join before
        either becomes part of a larger piece.
        """
        cost, lefts = self.v.cost, self.side(b, 0)
        for x, x_made, x_ends in self.side(a, 1):
            for y, y_made, y_ends in lefts:
                joined = cost.get(x + y)
                if joined is None:
                    continue
                # both exist from the later making on; the join wins over a later swallowing, at equal cost the left one comes first
                if max(x_made, y_made, joined) < min(x_ends, y_ends) or (x_made < min(x_ends, y_ends) and y_made < min(x_ends, y_ends) and joined < x_ends and joined <= y_ends):
                    return False
        return True

    def encode(self, word: str) -> tuple[int, ...]:
        """Ids of one word; words should come sorted."""
        v = self.v
        if word.startswith("  ") or word.isspace():
            pieces = self.merged(word)
        else:
            same, most = 0, min(len(word), len(self.path))
            while same < most and word[same] == self.path[same]:
                same += 1
            last, cost, tails, apart = self.last, v.cost, self.tails, self.apart
            del last[same + 1 :]
            for end in range(same + 1, len(word) + 1):
                begin = end - 1
                while begin and word[begin - 1 : end] in tails:
                    begin -= 1
                best = ""
                for begin in range(begin, end):
                    piece = word[begin:end]
                    if end - begin > 1 and (piece not in cost or not self.halves(piece)):
                        continue
                    before = last[begin]
                    if begin and before in cost and piece in cost:
                        fits = apart.get((before, piece))
                        if fits is None:
                            fits = apart[before, piece] = self.may_follow(before, piece)
                    else:
                        fits = not begin or before != ""
                    if fits:
                        best = piece
                        break
                last.append(best)
            self.path = word
            pieces, end = [], len(word)
            while end:
                pieces.append(last[end])
                end -= len(last[end])
            pieces.reverse()
        return tuple(chain.from_iterable((v.ids[p],) if p in v.ids else (v.bytes[b] for b in p.encode()) for p in pieces))


def encode_texts(texts: list[str], known: dict[str, bytes], encoder: Encoder) -> list[bytes]:
    """Ids of texts, as 32-bit numbers one after another; ``known`` gathers those of words."""
    words = [encoder.cut.findall(" " + t) if t else [] for t in texts]
    for word in sorted(set(chain.from_iterable(words)) - known.keys()):
        known[word] = array("i", encoder.encode(word)).tobytes()
    return [b"".join(map(known.__getitem__, ws)) for ws in words]


def decode_ids(ids: pa.ListArray, table: pa.BinaryArray) -> list[str]:
    """The texts of lists of ids; bytes that are no UTF-8 become replacement characters, nulls and ids out of range nothing."""
    n = len(table)
    flat = ids.flatten().fill_null(n).to_numpy(zero_copy_only=False)
    flat = np.where((flat >= 0) & (flat < n), flat, n)
    pieces = pa.concat_arrays([table, pa.array([b""], table.type)]).take(pa.array(flat))
    ends = np.frombuffer(pieces.buffers()[1], np.int32, len(pieces) + 1)
    data = pieces.buffers()[2].to_pybytes() if len(pieces) else b""
    sizes = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    at = ends[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)].tolist() if len(pieces) else [0] * (len(ids) + 1)
    return [data[lo:hi].removeprefix(b" ").decode("utf-8", "replace") for lo, hi in zip(at, at[1:])]


def encode(docs: DataFrame, keep: list[str], vocabulary: str = VOCABULARY, text: str = "text") -> DataFrame:
    """The ``keep`` columns of each row, then ids array<int> and n_pieces.

    Null and empty texts have no ids. The mark character U+2581 in a text is spelled in bytes, so that decoding gives it back.
    The vocabulary (megabytes, however large the corpus) is read by the driver and sent to the tasks.
    """
    shared = share(docs.sparkSession, Vocabulary(vocabulary))

    def start():
        encoder, known = Encoder(opened(shared)), Remembered(None, 150_000)

        def work(texts, part):
            known.trim()
            encoder.apart.trim()
            ids = encode_texts([(t or b"").decode("utf-8", "replace") for t in texts], known, encoder)
            sizes = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            return [pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(ids), np.int32))), pa.array(sizes)]

        return work

    return over_texts(docs, keep, "ids array<int>, n_pieces bigint", start, text, SORTED_BYTES)


def round_trip(docs: DataFrame, keep: list[str], vocabulary: str = VOCABULARY, text: str = "text") -> DataFrame:
    """As ``encode``, then same_text: does decoding the ids give the text back? Each text goes to a task once, for both ways.

    Null and empty texts have no ids, which decode to an empty text: both count as the same.
    """
    spark = docs.sparkSession
    read = Vocabulary(vocabulary)
    shared, pieces = share(spark, read), spark.sparkContext.broadcast(read.table())

    def start():
        encoder, known = Encoder(opened(shared)), Remembered(None, 150_000)
        table = pa.array(pieces.value, pa.binary())

        def work(texts, part):
            known.trim()
            encoder.apart.trim()
            whole = [(t or b"").decode("utf-8", "replace") for t in texts]
            ids = encode_texts(whole, known, encoder)
            sizes = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            made = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(ids), np.int32)))
            return [made, pa.array(sizes), [a == b for a, b in zip(whole, decode_ids(made, table), strict=True)]]

        return work

    return over_texts(docs, keep, "ids array<int>, n_pieces bigint, same_text boolean", start, text)


def decode(encoded: DataFrame, keep: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """The ``keep`` columns of each row, then decoded: the text of its ids (null ids: empty)."""
    from pyspark.sql.types import StringType, StructType

    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary).table())
    out = StructType([*encoded.select(*keep).schema.fields]).add("decoded", StringType())
    n_keep, at = len(keep), keep.index("ids") if "ids" in keep else len(keep)

    def run(batches):
        table = pa.array(shared.value, pa.binary())
        for b in batches:
            for lo, hi in slices(b.column(at).value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 1 << 20):
                part = b.slice(lo, hi - lo)
                texts = decode_ids(part.column(at), table)
                yield pa.RecordBatch.from_arrays([*part.columns[:n_keep], pa.array(texts, pa.string())], names=out.names)

    return (encoded.select(*keep) if at < n_keep else encoded.select(*keep, "ids")).mapInArrow(run, out)
