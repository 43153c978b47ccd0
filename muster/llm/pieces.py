"""SentencePiece BPE encoding by backtracking over longest matches, and decoding.

Merge-type BPE is exact without running the merges over the text: a sequence of pieces is the
encoding if and only if each two neighbours are what merging their joint characters gives. So the
encoder walks forward with the longest piece at each place (one Aho-Corasick pass finds them all),
checks it against its left neighbour by re-merging the two, falls back to the next shorter piece,
and steps back where none fits. Places that proved to be dead ends are kept in a bitfield and
never entered again, so the walk is linear in the length of the text.

No piece holds a space mark after another character, so no merge crosses such a place, and texts
are encoded in segments that start with space marks. Segments repeat, so their ids are kept in a
bounded memory. Characters outside the vocabulary become byte pieces.

Defined results: a null text is encoded like an empty one, to the begin and end ids alone.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache
from math import inf as INFINITY

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

SPACE = "▁"
_SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_REMEMBERED = 500_000  # runs, a few hundred bytes each; forgetting changes no result
_LONG = 64  # runs beyond this are not remembered


class PieceModel:
    """Vocabulary, merge order and byte pieces read from a model file, with encode and decode.

    The library is only asked for the table of pieces; a model that is not of the merge type, or
    that normalizes the text, is refused.
    """

    def __init__(self, model: bytes):
        table = SentencePieceProcessor(model_proto=model)
        size = table.get_piece_size()
        self.begin, self.end, self.unknown = table.bos_id(), table.eos_id(), table.unk_id()
        self.pieces = [table.id_to_piece(i) for i in range(size)]
        special = {i for i in range(size) if table.is_control(i) or table.is_unknown(i)}
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(size) if table.is_byte(i)}
        usable = [i for i in range(size) if i not in special and not table.is_byte(i)]
        self.ids = {self.pieces[i]: i for i in usable}
        self.scores = {self.pieces[i]: table.get_score(i) for i in usable}
        if len(self.byte_ids) != 256 or any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids):
            raise ValueError("a merge-type model with byte pieces and leading space marks is needed")
        if table.encode("ﬁ a  b", out_type=str)[:1] == [SPACE + "fi"]:
            raise ValueError("models that normalize the text are not supported")
        self.shown = [b""] * size
        for i in usable:
            self.shown[i] = self.pieces[i].replace(SPACE, " ").encode()
        for value, i in self.byte_ids.items():
            self.shown[i] = bytes([value])
        self.shown[self.unknown] = b" \xe2\x81\x87 "
        self.is_byte = bytearray(size)
        for i in self.byte_ids.values():
            self.is_byte[i] = 1
        self.pairs: dict[tuple[str, str], bool] = {}
        self.halves: dict[str, tuple[str, str]] = {}
        self.known = {p for p in self.ids if self.merged(p) == [p]}
        self.automaton = ahocorasick.Automaton()
        for p in self.known:
            self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        self.foreign = re.compile("[^" + re.escape("".join(p for p in self.known if len(p) == 1)) + "]+")
        self.memory: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """Plain merging of a short text: always the best-scored pair, of equals the leftmost.

        Used to learn from which two ``halves`` each piece is made at last.
        """
        parts: list[str | None] = list(text)
        after = list(range(1, len(parts))) + [-1]
        before = list(range(-1, len(parts) - 1))
        queue: list[tuple[float, int, int, str]] = []

        def offer(left: int, right: int) -> None:
            whole = parts[left] + parts[right]
            if whole in self.scores:
                heapq.heappush(queue, (-self.scores[whole], left, right, whole))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while queue:
            _, left, right, whole = heapq.heappop(queue)
            if parts[left] is None or parts[right] is None or parts[left] + parts[right] != whole:
                continue
            self.halves.setdefault(whole, (parts[left], parts[right]))
            parts[left], parts[right] = whole, None
            after[left] = after[right]
            if after[left] >= 0:
                before[after[left]] = left
                offer(left, after[left])
            if before[left] >= 0:
                offer(before[left], left)
        return [p for p in parts if p is not None]

    def fits(self, left: str, right: str) -> bool:
        """Whether merging the joint text of two neighbours gives these two again.

        The merges on both sides are replayed backwards. Two parts that meet at the border must not
        be a pair that would have been merged before one of them went into a larger part.
        """
        known = self.pairs.get((left, right))
        if known is not None:
            return known
        scores, halves = self.scores, self.halves
        at, to, known = left, right, True
        until = -INFINITY  # score of the merge that ended the meeting of ``at`` and ``to``
        by_right = False  # whether it was made on the right side, and so loses to an equal one at the border
        while True:
            pair = scores.get(at + to)
            if pair is not None and (pair > until or (pair == until and by_right)):
                known = False
                break
            a, b = halves.get(at), halves.get(to)
            if a is None and b is None:
                break
            by_right = a is None or (b is not None and scores[to] <= scores[at])
            if by_right:
                until, to = scores[to], b[0]
            else:
                until, at = scores[at], a[1]
        if len(self.pairs) > 2 * _REMEMBERED:
            self.pairs.clear()
        self.pairs[left, right] = known
        return known

    def walk(self, text: str) -> list[str]:
        """Pieces of a text whose characters are all in the vocabulary."""
        longest = [1] * len(text)
        for last, size in self.automaton.iter(text):
            if size > longest[last - size + 1]:
                longest[last - size + 1] = size
        known, fits, pairs, stop = self.known, self.fits, self.pairs, len(text)
        dead = 0  # bit k: no valid rest begins at place k
        chosen: list[str] = []
        left, at, size = "", 0, longest[0]
        while at < stop:
            while size:
                piece = text[at:at + size]
                if piece in known and not (dead and dead >> (at + size) & 1):
                    fit = pairs.get((left, piece)) if left else True
                    if fit or (fit is None and fits(left, piece)):
                        break
                size -= 1
            if size:
                chosen.append(piece)
                left = piece
                at += size
                size = longest[at] if at < stop else 0
            else:
                dead |= 1 << at
                size = len(chosen.pop())
                left = chosen[-1] if chosen else ""
                at -= size
                size -= 1
        return chosen

    def run(self, text: str) -> bytes:
        """Packed ids of a run of characters of the vocabulary."""
        found = self.memory.get(text)
        if found is None:
            ids = array("I", [self.ids[p] for p in self.walk(text)])
            if sys.byteorder == "big":
                ids.byteswap()
            found = ids.tobytes()
            if len(text) <= _LONG:
                if len(self.memory) >= _REMEMBERED:
                    self.memory.clear()
                self.memory[text] = found
        return found

    def segment(self, text: str) -> bytes:
        """Packed ids of a segment, in which other characters may stand between runs."""
        found, at = [], 0
        for gap in self.foreign.finditer(text):
            if gap.start() > at:
                found.append(self.run(text[at:gap.start()]))
            found.extend([self.byte_ids[b].to_bytes(4, "little") for b in gap[0].encode()])
            at = gap.end()
        if at < len(text):
            found.append(self.run(text[at:]))
        return b"".join(found)

    def encode(self, text: str) -> bytes:
        """Begin id, ids of the text, end id, as little-endian 32-bit integers."""
        memory, segment = self.memory, self.segment
        body = _SEGMENT.findall(SPACE + text.replace(" ", SPACE)) if text else []
        return b"".join([self.begin.to_bytes(4, "little"),
                         *[memory.get(s) or segment(s) for s in body],
                         self.end.to_bytes(4, "little")])

    def decode(self, packed: bytes) -> str:
        """Text of the ids: pieces laid end to end, bytes read as UTF-8, the first space mark off.

        Each byte that belongs to no whole character shows as U+FFFD.
        """
        ids = array("I")
        ids.frombytes(packed)
        if sys.byteorder == "big":
            ids.byteswap()
        shown = self.shown
        body = b"".join([shown[i] for i in ids])
        first = next((i for i in ids if i not in (self.begin, self.end)), None)
        if first is not None and self.pieces[first].startswith(SPACE):
            body = body[1:]
        try:
            return body.decode()
        except UnicodeDecodeError:
            return body.decode(errors="bytewise")


@lru_cache(maxsize=2)
def _loaded(model: bytes) -> PieceModel:
    """One table per worker process and model."""
    return PieceModel(model)


def _bytewise(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


def _tokens(model: bytes, with_ids: bool):
    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import codecs
        codecs.register_error("bytewise", _bytewise)
        pieces = _loaded(model)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows = []
                for text in batch.column("__text"):
                    packed = pieces.encode(text.as_py() or "")
                    plain = pieces.decode(packed)
                    rows.append((len(packed) // 4, hashlib.sha256(packed).hexdigest(),
                                 hashlib.sha256(plain.encode()).hexdigest())
                                + ((memoryview(packed).cast("I").tolist(), plain) if with_ids else ()))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                names = ["n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
                yield pa.RecordBatch.from_arrays([batch.column("__doc"), *columns],
                                                 ["__doc", *names[:len(columns)]])
    return tokens


def tokenize(docs: DataFrame, model_path: str, text: str = "text", with_ids: bool = True) -> DataFrame:
    """Every row without its text, with ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if
    asked for, the ``ids`` and the ``decoded`` text. Own columns of these names are replaced.

    The model file (half a megabyte, independent of the data) travels with the tasks.
    """
    with open(model_path, "rb") as file:
        model = file.read()
    names = {text, "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"}
    bare = docs.select(F.struct(*[c for c in docs.columns if c not in names]).alias("__doc"),
                       F.col(text).alias("__text"))
    kind = bare.schema["__doc"].dataType.simpleString()
    more = ", ids array<int>, decoded string" if with_ids else ""
    found = bare.mapInArrow(_tokens(model, with_ids), f"__doc {kind}, n_tokens long, ids_sha256 string, "
                                                      f"decoded_sha256 string{more}")
    return found.select("__doc.*", *found.columns[1:])
