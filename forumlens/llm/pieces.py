"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

The model file is read once per worker: pieces, scores and normaliser flags. Spaces become the meta symbol and one is
put in front, as the normaliser of the file says. The text is cut before every run of meta symbols: no piece of the
vocabulary has a meta symbol behind another character (checked when the file is read), so no merge crosses a cut and
each part is encoded on its own. A part is merged by a score-ordered agenda: all adjacent symbol pairs that form a
piece wait by (score, place); the best one is merged, the pairs that it invalidates leave, and the pairs to both sides
of the new symbol are entered. The agendas of short parts advance together, one row of an array each; a long part has
its agenda in a heap. Characters outside the vocabulary become byte pieces.

Parts repeat, so their ids stay in a store of bounded size. Every part that enters the store is encoded by the
sentencepiece library too, together with the other new parts of its Arrow batch, and the ids must be equal; a
difference raises an error.

Results on edges: a null text counts as empty; an empty text encodes to the end id alone (or to nothing without it)
and decodes to an empty text. A meta symbol that stands in a text is a space, as in the library, so it decodes to a
space. Decoding drops one leading space, ignores control ids, and turns every byte that is no valid UTF-8 into U+FFFD.
"""

from __future__ import annotations

import codecs
import heapq
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField

from forumlens.llm.common import BOOK, append_from_texts, table

META = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6   # fixed values: piece types of the file format
STORE_PARTS = 600_000     # parts in the store of a worker; beyond, it starts anew
SHORT = 24                # symbols of a part whose agenda is a row of an array
ROWS = 20_000             # rows of that array
STORED_CHARS = 64         # longer parts are merged each time they occur
_CUT = re.compile(r" *[^ ]+| +")


def _one_byte(error):
    return "�", error.start + 1


codecs.register_error("forumlens_one_byte", _one_byte)


class Vocabulary:
    """Pieces of a model file and the agenda over them."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        with open(path, "rb") as file:
            content = file.read()
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(content)
        normal = model.normalizer_spec
        if model.trainer_spec.model_type != 2:
            raise ValueError("only merge-type vocabularies are handled")
        if normal.precompiled_charsmap or normal.remove_extra_whitespaces or not (normal.escape_whitespaces and normal.add_dummy_prefix):
            raise ValueError("only an identity normaliser with a leading space is handled")
        if any(p.type in (USER, UNUSED) for p in model.pieces) or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("user-defined and unused pieces are not handled")
        self.library = SentencePieceProcessor(model_proto=content)
        self.score = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.number = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        if any(META in p.lstrip(META) for p in self.score):
            raise ValueError("a piece has a space inside: parts would not be independent")
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        bytes_at = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.byte = [bytes_at[b] for b in range(256)] if len(bytes_at) == 256 else None
        self.end = self.library.eos_id()
        if self.end < 0:
            raise ValueError("the vocabulary has no end id")
        self.surface = [b"" if p.type == CONTROL else bytes([int(p.piece[3:5], 16)]) if p.type == BYTE
                        else model.trainer_spec.unk_surface.encode() if p.type == UNKNOWN
                        else p.piece.replace(META, " ").encode() for p in model.pieces]
        self.starts_blank = [p.type == NORMAL and p.piece.startswith(META) for p in model.pieces]
        self.control = {i for i, p in enumerate(model.pieces) if p.type == CONTROL}
        self._pair_table()
        self._clear()

    def _clear(self) -> None:
        self.row: dict[str, int] = {}
        self.starts = np.zeros(1, np.int64)
        self.flat = np.zeros(0, np.int32)

    def _pair_table(self) -> None:
        """Every way to put a piece together from two pieces, as sorted keys next to rank and result.

        Equal scores get equal ranks, so the first minimum of a row is the leftmost of the best."""
        number, n = self.number, len(self.surface)
        self.width = n
        order = {score: r for r, score in enumerate(sorted(set(self.score.values()), reverse=True))}
        rows = sorted((number[p[:i]] * n + number[p[i:]], order[self.score[p]], number[p]) for p in number
                      for i in range(1, len(p)) if p[:i] in number and p[i:] in number)
        table = np.array(rows, np.int64).reshape(-1, 3)
        self.pair_key, self.pair_rank, self.pair_piece = (np.ascontiguousarray(table[:, i]) for i in range(3))
        self.no_pair = len(order)
        single = np.full(0x110000, -1, np.int32)
        for piece, i in number.items():
            if len(piece) == 1:
                single[ord(piece)] = i
        self.single = single
        # where a character is no piece itself, symbols are not all numbers and every part takes the heap
        self.closed = all(c in number for p in number for c in p)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = np.where((left < 0) | (right < 0), -1, left.astype(np.int64) * self.width + right)
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        hit = self.pair_key[at] == key
        return np.where(hit, self.pair_rank[at], self.no_pair).astype(np.int32), self.pair_piece[at].astype(np.int32)

    def merge_rows(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids and ids of short parts, their agendas advanced together: one merge per part and round."""
        n = len(parts)
        lengths = np.fromiter(map(len, parts), np.int64, n)
        width = int(lengths.max())
        points = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
        inside = np.arange(width) < lengths[:, None]
        symbol = np.full((n, width + 1), -1, np.int32)          # one more column, always empty
        numbers = self.single[points]
        # characters outside the vocabulary are ASCII here; below -1, they never merge
        symbol[:, :width][inside] = np.where(numbers < 0, -2 - points.astype(np.int32), numbers)
        agenda, made = self._ranks(symbol[:, :-1], symbol[:, 1:])
        columns = np.arange(width + 1)
        live = np.arange(n)
        while True:
            best = agenda.argmin(axis=1)
            open_ = agenda[np.arange(len(live)), best] < self.no_pair
            live, best = live[open_], best[open_]
            if not len(live):
                break
            agenda, made = agenda[open_], made[open_]
            rows = np.arange(len(live))
            own = symbol[live]
            own[rows, best] = made[rows, best]
            own = np.take_along_axis(own, np.minimum(columns + (columns > best[:, None]), width), axis=1)
            symbol[live] = own
            # of the agenda, the entry of the merged pair leaves and its neighbours are entered anew
            moved = np.minimum(columns[:-1] + (columns[:-1] >= best[:, None]), width - 1)
            agenda, made = np.take_along_axis(agenda, moved, axis=1), np.take_along_axis(made, moved, axis=1)
            agenda[:, -1] = self.no_pair
            agenda[rows, best], made[rows, best] = self._ranks(own[rows, best], own[rows, best + 1])
            before = np.maximum(best - 1, 0)
            agenda[rows, before], made[rows, before] = self._ranks(own[rows, before], own[rows, before + 1])
        there = symbol != -1
        flat = symbol[there]
        strange = flat < -1
        if strange.any():
            flat[strange] = np.array(self.byte, np.int32)[-2 - flat[strange]]
        return there.sum(axis=1), flat

    def _alike(self, part: str) -> bool:
        """Whether a part can take a row of the array: short, and all it has outside the vocabulary is ASCII."""
        return len(part) <= SHORT and self.closed and bool(self.byte) and (
            part[1:].isascii() or all(c in self.number or c < "\x80" for c in part))

    def merge(self, part: str) -> list[str]:
        """The symbols of a part after all merges, best score first, then leftmost."""
        symbols: list[str | None] = list(part)
        n = len(symbols)
        score = self.score
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            s = score.get(pair)
            if s is not None:
                agenda.append((-s, i, pair))
        heapq.heapify(agenda)
        pop, push = heapq.heappop, heapq.heappush
        while agenda:
            _, i, pair = pop(agenda)
            left = symbols[i]
            if left is None:
                continue
            j = after[i]
            if j >= n or len(left) + len(symbols[j]) != len(pair) or left + symbols[j] != pair:
                continue
            symbols[i], symbols[j] = pair, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                longer = pair + symbols[k]
                s = score.get(longer)
                if s is not None:
                    push(agenda, (-s, i, longer))
            h = before[i]
            if h >= 0:
                longer = symbols[h] + pair
                s = score.get(longer)
                if s is not None:
                    push(agenda, (-s, h, longer))
        return [s for s in symbols if s is not None]

    def part_ids(self, part: str) -> list[int]:
        """Ids of one part, in which spaces are written as meta symbols."""
        ids: list[int] = []
        for symbol in self.merge(part):
            i = self.number.get(symbol)
            if i is not None:
                ids.append(i)
            elif self.byte:
                ids.extend([self.byte[b] for b in symbol.encode("utf-8")])
            elif not ids or ids[-1] != self.unknown:  # unknown characters in a row are one unknown piece
                ids.append(self.unknown)
        return ids

    def learn(self, parts: list[str]) -> None:
        """Encode new parts, compare them with the library, and store them. A part comes without its first space."""
        parts = sorted(parts, key=len)
        short, long = [], []
        for part in parts:
            (short if self._alike(META + part) else long).append(part)
        counts, ids = [], []
        for at in range(0, len(short), ROWS):
            n, flat = self.merge_rows([META + p.replace(" ", META) for p in short[at:at + ROWS]])
            counts.append(n)
            ids.append(flat)
        for part in long:
            own = self.part_ids(META + part.replace(" ", META))
            counts.append([len(own)])
            ids.append(np.array(own, np.int32))
        parts = short + long
        counts, ids = np.concatenate(counts).astype(np.int64), np.concatenate(ids).astype(np.int32)
        theirs = self.library.encode(parts, num_threads=1)
        if "" in parts:  # the library gives no id for an empty text, here it stands for a single space
            theirs[parts.index("")] = [self.number[META]]
        if not (np.array_equal(counts, np.fromiter(map(len, theirs), np.int64, len(theirs)))
                and np.array_equal(ids, np.fromiter(chain.from_iterable(theirs), np.int32))):
            ends = np.cumsum(counts)
            wrong = next(p for p, e, n, t in zip(parts, ends, counts, theirs) if ids[e - n:e].tolist() != t)
            raise ValueError(f"the ids of {wrong!r} differ from the library's")
        base = len(self.row)
        self.row.update(zip(parts, range(base, base + len(parts))))
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(counts)])
        self.flat = np.concatenate([self.flat, ids])

    def parts_of(self, text: str) -> list[str]:
        """The text cut before each run of spaces, every part without its first space."""
        if META in text:
            text = text.replace(META, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [p[1:] for p in _CUT.findall(" " + text)]
        return text.split(" ")

    def encode(self, texts: list[str | None], end: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of a batch: offsets of the texts, and all ids one after the other."""
        parts: list[str] = []
        limits = [0]
        for text in texts:
            if text:
                parts += self.parts_of(text)
            limits.append(len(parts))
        at = self._rows(parts)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = list({p for p in map(parts.__getitem__, missing.tolist()) if len(p) <= STORED_CHARS})
            if len(self.row) + len(new) > STORE_PARTS:
                self._clear()
                new = list({p for p in parts if len(p) <= STORED_CHARS})
            if new:
                self.learn(new)
            at = self._rows(parts)
            missing = np.flatnonzero(at < 0)
        counts, flat = self._ragged(at, {int(i): self.long_part(parts[i]) for i in missing})
        per_text = np.concatenate([[0], np.cumsum(counts)])[limits]
        if not end:
            return per_text, flat
        offsets = per_text + np.arange(len(limits))
        with_end = np.empty(len(flat) + len(texts), np.int32)
        ends = np.zeros(len(with_end), bool)
        ends[offsets[1:] - 1] = True
        with_end[ends] = self.end
        with_end[~ends] = flat
        return offsets, with_end

    def _rows(self, parts: list[str]) -> np.ndarray:
        return np.fromiter(map(self.row.get, parts, repeat(-1)), np.int64, len(parts))

    def _ragged(self, rows: np.ndarray, long: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids of the parts, and their ids one after the other; ``long`` has those without a row."""
        starts = self.starts[rows]                     # row -1 is the end of the store: no ids
        sizes = np.where(rows < 0, 0, self.starts[np.minimum(rows + 1, len(self.starts) - 1)] - starts)
        for i, ids in long.items():
            sizes[i] = len(ids)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        begins = ends - sizes
        places = np.repeat(starts - begins, sizes) + np.arange(total)
        if not long:
            return sizes, self.flat[places]
        out = np.take(self.flat, places, mode="clip") if len(self.flat) else np.zeros(total, np.int32)
        for i, ids in long.items():
            out[begins[i]:ends[i]] = ids
        return sizes, out

    def long_part(self, part: str) -> np.ndarray:
        own = self.part_ids(META + part.replace(" ", META))
        if own != self.library.encode(part):
            raise ValueError("the ids of a long part differ from the library's")
        return np.array(own, np.int32)

    def decode(self, ids: list[int]) -> str:
        """The text of a list of ids."""
        raw = b"".join(map(self.surface.__getitem__, ids))
        first = next((i for i in ids if i not in self.control), None)
        if first is not None and self.starts_blank[first]:
            raw = raw[1:]
        return raw.decode("utf-8", "forumlens_one_byte")


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, text: str = "text", model: str | None = None, end: bool = True, ids: str = "ids",
           decoded: str | None = "decoded", keep: list[str] | None = None) -> DataFrame:
    """Append the ids of every text and, unless ``decoded`` is None, the text that they decode to.

    The model file is looked up on each worker: a path, or the default file of the installed tokenizers.
    """
    fields = [StructField(ids, ArrayType(IntegerType(), False))] + ([StructField(decoded, StringType())] if decoded else [])

    def compute(texts):
        pieces = vocabulary(model or model_path())
        offsets, flat = pieces.encode(texts, end)
        if offsets[-1] >= 1 << 31:
            raise ValueError("too many ids in one Arrow batch: lower spark.sql.execution.arrow.maxRecordsPerBatch")
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.astype(np.int32)),
                                         type=pa.list_(pa.field("element", pa.int32(), False)))
        if not decoded:
            return [lists]
        return [lists, [pieces.decode(flat[a:b].tolist()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]]

    return append_from_texts(docs, text, fields, compute, keep)


def decode(table_of_ids: DataFrame, ids: str = "ids", decoded: str = "decoded", model: str | None = None) -> DataFrame:
    """Append the text of every list of ids; null ids count as an empty list."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def texts(column):
        import pandas as pd

        pieces = vocabulary(model or model_path())
        return pd.Series([pieces.decode([int(i) for i in x]) if x is not None else "" for x in column], dtype=object)

    return table_of_ids.withColumn(decoded, texts(F.col(ids)))


def digests(encoded: DataFrame) -> list:
    """The columns that a result carries instead of ids and texts."""
    return [F.size("ids").cast("long").alias("n_tokens"),
            F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
            F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")]


@BOOK.add("op5_sentencepiece")
def sentencepiece_round_trip(spark, sf_dir):
    """Ids of every document and the text they decode to, as digests."""
    encoded = encode(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return encoded.select("doc_id", *digests(encoded))
