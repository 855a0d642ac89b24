"""Token counts by a finite-state machine compiled from a byte-level BPE vocabulary.

The machine reads characters. A state says where the text stands in the pre-tokenizer (inside letters, numbers, other
signs, blanks, or behind an apostrophe) and what the merges of the current word still depend on. Every transition
carries the number of tokens that it adds, which may be zero or below zero when a character joins earlier tokens into
one; the sum along a text is its token count.

How one state can know the merges: the tokens of a prefix end in exactly one last token, the one that is a valid
neighbour of the last token before it (two tokens are valid neighbours if the merges of their joint text give just
these two). So it suffices to remember, for each place in the word from which a longer token may still start, the
vocabulary trie node reached since, the last token at that place, and the token count there relative to now. Those are
finitely many. States and transitions are compiled when first needed and kept, up to ``MAX_KEPT`` of them; beyond,
the machine is emptied and compiled anew, so memory is bounded for any input.

Between a character and a blank behind it every word ends, so a text falls into pieces (blanks, then other characters)
that are counted each by itself, and the counts of short pieces are kept: most are read by the machine once per worker.

Texts of more than ``LONG_CHARS`` become rows of chunks, which Spark spreads over its tasks. The map of a chunk tells, for
the state in front of it, the state behind it and the tokens in between. It is kept as the run from one state, with the
states and counts at some marks on the way (their distances double), and for any other state by running the chunk from
there up to the first mark at which it is in the same state: from then on both runs are one. Behind a blank that is at
once, inside an unbroken run mostly after a few tokens. The maps of a text are then composed by position, one after the
other, in time for a few characters each, whatever the text holds.

Results on edges: a null text counts as empty, an empty text has no tokens. The special strings that the library
recognises inside texts by default count as one token each and separate what stands around them. Equal long texts are
read once per task and composed once.
"""

from __future__ import annotations

import json
import pickle
import re
import unicodedata
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from forumlens.llm.common import BOOK, append_from_texts, col, table, without
from forumlens.session import small_side

MAX_KEPT = 1_000_000      # states, transitions and remembered pairs of tokens
FEW_TOKENS = 64
LONG_CHARS = 1 << 20       # characters of a text above which it is read in chunks
CHUNK_CHARS = 1 << 16
FIRST_MARK = 16
KEPT_CHARS = 48           # characters of a piece whose count is kept
MAX_PIECES = 500_000
LIMIT = 1024
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")    # fixed values of the pre-tokenizer, behind an apostrophe
LETTER, NUMBER, BLANK, OTHER = range(4)


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the
    others for the next free code points from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class State:
    """A state of the machine: transitions by character, and the tokens that the end of the text adds."""
    __slots__ = ("key", "to", "at_end")

    def __init__(self, key, at_end):
        self.key, self.to, self.at_end = key, {}, at_end


class ChunkMap(NamedTuple):
    """A chunk and its run from the start: (characters read, name of the state, tokens so far) at each mark, the last at its end."""
    text: str
    marks: list


class Known(dict):
    """Token counts of pieces; a missing one is counted, and kept if it is short."""

    def __init__(self, count):
        super().__init__()
        self.count = count

    def __missing__(self, piece: str) -> int:
        n = self.count(piece)
        if len(piece) <= KEPT_CHARS:
            self[piece] = n
        return n


class Machine:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, before = spec["model"], spec["pre_tokenizer"]
        if (model["type"], before["type"], before.get("add_prefix_space"), before.get("use_regex", True)) != ("BPE", "ByteLevel", False, True) or spec["normalizer"]:
            raise ValueError("only plain byte-level BPE vocabularies are handled")
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec.get("added_tokens", [])):
            raise ValueError("only plain special strings are handled")
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        text = {i: bytes(byte_of[c] for c in piece) for piece, i in model["vocab"].items() if piece not in self.special}
        number = {t: i for i, t in text.items()}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank, self.split = {}, {}
        for r, (a, b) in enumerate(pairs):
            left, right = (model["vocab"][x] for x in (a, b))
            self.rank[left, right] = (r, model["vocab"][a + b])
            self.split.setdefault(model["vocab"][a + b], (left, right))
        self.single = [number[bytes([b])] for b in range(256)]
        # the trie of all token texts: node -> {byte: node}, and the token that ends in a node
        self.child: list[dict[int, int]] = [{}]
        self.token: list[int | None] = [None]
        for i, t in text.items():
            if i not in self.split and len(t) > 1:
                continue  # no merge makes it
            node = 0
            for b in t:
                if b not in self.child[node]:
                    self.child[node][b] = len(self.child)
                    self.child.append({})
                    self.token.append(None)
                node = self.child[node][b]
            self.token[node] = i
        self.tokens_in = self._tokens_below()
        self.neighbours: dict[tuple[int, int], bool] = {}
        self.alike: dict[tuple[int, int], int | None] = {}
        self.first_with: dict = {}
        self.kinds: dict[str, int] = {}
        self.known = Known(self._count_piece)
        self.clear()

    def clear(self) -> None:
        self.states: dict = {}
        self.steps = 0
        self.neighbours.clear()
        self.alike.clear()
        self.first_with.clear()
        self.start = self.state(("begin", None, None))

    def _tokens_below(self) -> list[tuple[int, ...] | None]:
        """The tokens that end below each trie node; None where they are many."""
        below: list = [()] * len(self.child)
        for node in range(len(self.child) - 1, -1, -1):  # children have higher numbers
            found: list | None = []
            for down in self.child[node].values():
                if below[down] is None or len(found) + len(below[down]) >= FEW_TOKENS:
                    found = None
                    break
                found += [*below[down], *([] if self.token[down] is None else [self.token[down]])]
            below[node] = found if found is None else tuple(found)
        return below

    def stand_in(self, node: int, last: int) -> int | None:
        """A token that has the same valid neighbours below a node as ``last``; None if it has none there.
        States that differ in such tokens only are one state."""
        tokens = self.tokens_in[node]
        if tokens is None or last < 0:
            return last
        key = (node, last)
        if key not in self.alike:
            fitting = tuple(t for t in tokens if self.valid(last, t))
            self.alike[key] = self.first_with.setdefault((node, fitting), last) if fitting else None
        return self.alike[key]

    # --- merges of one word, byte by byte -----------------------------------------------------------

    def valid(self, left: int, right: int) -> bool:
        """Whether the merges of the joint text of two tokens give these two tokens: undo the later merge of both
        along their seam, and look whether a pair over the seam would have been merged before."""
        limit = 1 << 40
        a, b = left, right
        while True:
            over = self.rank.get((a, b))
            if over and over[0] < limit:
                return False
            down_a, down_b = self.split.get(a), self.split.get(b)
            if down_a is None and down_b is None:
                return True
            rank_a = self.rank[down_a][0] if down_a else -1
            rank_b = self.rank[down_b][0] if down_b else -1
            if rank_a > rank_b:
                # the left token was finished last; a pair over the seam of the same rank stands right of it
                limit, a = rank_a, down_a[1]
            else:
                # the right token was finished last; a pair over the seam of the same rank stands left of it
                limit, b = rank_b + 1, down_b[0]

    def fits(self, left: int, right: int) -> bool:
        key = (left, right)
        known = self.neighbours.get(key)
        if known is None:
            known = self.neighbours[key] = self.valid(left, right)
        return known

    def feed(self, word, b: int):
        """One more byte of a word. ``word`` is None (no byte yet) or a tuple of (trie node, last token before that
        place or -1, tokens up to that place less the tokens up to now). Returns the new word and the tokens added."""
        found = None
        alive = []
        for node, last, relative in word or ((0, -1, 0),):
            down = self.child[node].get(b)
            if down is None:
                continue
            alive.append((down, last, relative))
            token = self.token[down]
            if token is not None and found is None and (last < 0 or self.fits(last, token)):
                found = (token, relative + 1)  # places come in order, so this is the longest; only one is valid
        token, added = found
        kept = []
        for node, last, relative in alive:
            if self.child[node]:
                last = self.stand_in(node, last)
                if last is not None:
                    kept.append((node, last, relative - added))
        return (*kept, (0, token, 0)), added

    def feed_text(self, word, char: str):
        added = 0
        for b in char.encode("utf-8", "surrogatepass"):
            word, more = self.feed(word, b)
            added += more
        return word, added

    # --- the pre-tokenizer and its states -------------------------------------------------------------

    def kind(self, char: str) -> int:
        known = self.kinds.get(char)
        if known is None:
            group = unicodedata.category(char)[0]
            known = BLANK if is_blank(char) else LETTER if group == "L" else NUMBER if group == "N" else OTHER
            self.kinds[char] = known
        return known

    def state(self, key) -> State:
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = State(key, self.ending(key))
        return found

    def ending(self, key) -> int:
        """Tokens added when the text ends in a state: what was held back is read."""
        mode, word, held = key
        if mode in ("begin", "word"):
            return 0
        if mode == "apostrophe":  # what follows the apostrophe so far is a word of its own
            return self.feed_text(None, "'")[1] + (self.feed_text(None, held)[1] if held else 0)
        return self.feed_text(word, held)[1]

    def begin(self, char: str):
        """A word begins with a character: the new key and the tokens added."""
        kind = self.kind(char)
        if kind == BLANK:
            return ("blank", None, char), 0
        if char == "'":
            return ("apostrophe", None, ""), 0
        word, added = self.feed_text(None, char)
        return ("word", word, kind), added

    def after(self, key, char: str):
        """The key reached from a state by a character, and the tokens added."""
        mode, word, held = key
        if mode == "begin":
            return self.begin(char)
        if mode == "word":  # held: the kind of its characters
            if self.kind(char) == held and held != BLANK:
                word, added = self.feed_text(word, char)
                return ("word", word, held), added
            return self.begin(char)
        if mode == "apostrophe":  # an apostrophe began the word; held: a letter after it that may be a contraction
            joined = held + char
            if joined in CONTRACTIONS:
                word, added = None, 0
                for c in "'" + joined:
                    word, more = self.feed_text(word, c)
                    added += more
                return ("begin", None, None), added
            if any(c.startswith(joined) for c in CONTRACTIONS):
                return ("apostrophe", None, joined), 0
            if held:  # no contraction: the apostrophe is a word, and its letter begins the next one
                _, added = self.feed_text(None, "'")
                word, more = self.feed_text(None, held)
                new, last = self.after(("word", word, LETTER), char)
                return new, added + more + last
            word, added = self.feed_text(None, "'")
            new, more = self.after(("word", word, OTHER), char)
            return new, added + more
        # blanks: all but the last are in the word, the last one is held back
        if self.kind(char) == BLANK:
            word, added = self.feed_text(word, held)
            return ("blank", word, char), added
        if held == " ":  # a space joins the word behind it
            word, added = self.feed_text(None, " ")
            word, more = self.feed_text(word, char)
            return ("word", word, self.kind(char)), added + more
        _, added = self.feed_text(None, held)
        new, more = self.begin(char)
        return new, added + more

    def run(self, state: State, text: str) -> tuple[State, int]:
        """The state behind a text and the tokens added on the way."""
        total = 0
        for char in text:
            step = state.to.get(char)
            if step is None:
                key, added = self.after(state.key, char)
                self.steps += 1
                if self.steps + len(self.states) + len(self.alike) + len(self.neighbours) > MAX_KEPT:
                    self.clear()
                step = state.to[char] = (self.state(key), added)
            state, added = step
            total += added
        return state, total

    # --- chunk maps -------------------------------------------------------------------------------------

    def chunk_map(self, text: str) -> ChunkMap:
        state, total, marks, at, size = self.start, 0, [], 0, FIRST_MARK
        while at < len(text):
            state, added = self.run(state, text[at:at + size])
            at, total, size = at + size, total + added, size * 2 if marks else size
            marks.append((at, state.key, total))
        return ChunkMap(text, marks)

    def follow(self, state: State, chunk: ChunkMap) -> tuple[State, int]:
        """The state behind a chunk, and the tokens added, from any state in front of it."""
        at = total = 0
        for end, key, tokens in chunk.marks:
            state, added = self.run(state, chunk.text[at:end])
            at, total = end, total + added
            if state.key == self.own_name(key):
                _, last, whole = chunk.marks[-1]
                return self.state(self.own_name(last)), total + whole - tokens
        return state, total

    def own_name(self, key):
        """The key under which this machine knows a state that another one named."""
        mode, word, held = key
        if word is None:
            return key
        renamed = []
        for node, last, relative in word[:-1]:
            last = self.stand_in(node, last)
            if last is not None:
                renamed.append((node, last, relative))
        return mode, (*renamed, word[-1]), held

    def count_chunks(self, chunks: list[ChunkMap]) -> int:
        """Tokens of a text from the maps of its chunks, in order."""
        state, total = self.start, 0
        for chunk in chunks:
            state, added = self.follow(state, chunk)
            total += added
        return total + state.at_end

    # --- whole texts --------------------------------------------------------------------------------------

    def _count_piece(self, piece: str) -> int:
        state, tokens = self.run(self.start, piece)
        return tokens + state.at_end

    def count_part(self, text: str) -> int:
        """Tokens of a text without special strings."""
        total = sum(map(self.known.__getitem__, _PIECES.findall(text)))
        if len(self.known) > MAX_PIECES:
            self.known.clear()
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.cut is None or not self.cut.search(text):
            return self.count_part(text)
        parts = self.cut.split(text)
        return len(parts) - 1 + sum(map(self.count_part, parts))


# fixed values: the Unicode White_Space characters
_BLANK_SET = frozenset(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
                                 0x202F, 0x205F, 0x3000]))


def is_blank(char: str) -> bool:
    return char in _BLANK_SET


_BLANKS = "".join(sorted(_BLANK_SET))
_PIECES = re.compile(f"[{_BLANKS}]*[^{_BLANKS}]+|[{_BLANKS}]+")


_LOADED: dict[str, Machine] = {}


def machine(path: str) -> Machine:
    if path not in _LOADED:
        _LOADED[path] = Machine(path)
    return _LOADED[path]


def model_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, text: str = "text", model: str | None = None, out: str = "n_tokens",
                 keep: list[str] | None = None, long_chars: int = LONG_CHARS, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Append the number of tokens of every text; the model file is read on each worker.

    Long texts are read a second time, as chunks; their counts are joined by the digest of the text."""
    def compute(texts):
        counts = machine(model or model_path())
        return [[None if t is None else counts.count(t) for t in texts]]

    content = F.coalesce(col(text).cast("string"), F.lit(""))
    is_long = F.length(content) > long_chars
    names = [out, "__short", "__digest"]
    kept = [c for c in without(docs, names) if keep is None or c in keep]
    marked = docs.select(*[col(c) for c in kept], F.when(~is_long, content).alias("__short"), F.when(is_long, F.sha2(content, 256)).alias("__digest"))
    counted = append_from_texts(marked, "__short", [StructField("__n", LongType())], compute, [*kept, "__digest"])
    long = long_counts(docs.select(content.alias("text")).filter(is_long), model, chunk_chars)
    return (counted.join(small_side(long), "__digest", "left")
            .select(*[col(c) for c in kept], F.coalesce("__n", "__long").alias(out)))


def long_counts(texts: DataFrame, model: str | None, chunk_chars: int) -> DataFrame:
    """(__digest, __long): tokens of every text of a table, by maps of its chunks."""
    special = machine(model or model_path()).special
    pattern = "|".join("\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E" for s in sorted(special, key=len, reverse=True))
    parts = F.split("text", pattern, -1) if special else F.array("text")
    pieces = texts.select(F.sha2("text", 256).alias("__digest"), F.posexplode(parts).alias("part", "content"))
    places = F.sequence(F.lit(0), F.greatest(F.floor((F.length("content") - 1) / chunk_chars).cast("int"), F.lit(0)))
    chunks = pieces.select("__digest", "part", "content", F.explode(places).alias("place")).select(
        "__digest", "part", "place", F.substring(F.col("content"), F.col("place") * chunk_chars + 1, F.lit(chunk_chars)).alias("text"))

    def run(batches):
        counts = machine(model or model_path())
        for batch in batches:
            marks = [pickle.dumps(counts.chunk_map(t).marks) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks, pa.binary())], [*batch.schema.names, "marks"])

    def compose(rows: pa.Table) -> pa.Table:
        counts = machine(model or model_path())
        found: dict = {}
        for part, place, text, marks in zip(*(rows.column(c).to_pylist() for c in ("part", "place", "text", "marks"))):
            found.setdefault(part, {})[place] = ChunkMap(text, pickle.loads(marks))
        total = sum(counts.count_chunks([one[p] for p in sorted(one)]) for one in found.values())
        return pa.table({"__digest": [rows.column("__digest")[0].as_py()], "__long": [total + len(found) - 1]})

    maps = (chunks.repartition("__digest", "part", "place").mapInArrow(run, "__digest string, part int, place int, text string, marks binary")
            .dropDuplicates(["__digest", "part", "place"]))
    return maps.groupBy("__digest").applyInArrow(compose, "__digest string, __long long")


def judged(docs: DataFrame, text: str = "text", limit: int = LIMIT, keep: list[str] | None = None, **options) -> DataFrame:
    """Bytes and tokens of every text and whether the tokens exceed a limit."""
    sized = docs.withColumn("n_bytes", F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long"))
    counted = count_tokens(sized, text, keep=None if keep is None else [*keep, "n_bytes"], **options)
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))


@BOOK.add("op10_token_counts")
def token_counts(spark, sf_dir):
    """Tokens of every document."""
    return judged(table(spark, sf_dir, "documents"), keep=["doc_id"])
