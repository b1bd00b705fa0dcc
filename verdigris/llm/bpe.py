"""BPE encoding and decoding with a tokenization automaton.

`Automaton` compiles the merge list by successive merge gadgets. Before any merge there is one
state with an arc for every base symbol. The gadget of merge (u, v), in rank order, splits the
state behind u: the new state lacks the arc v, and wherever an arc u leaves, an arc uv is added
that ends where v ended. What stays readable after all gadgets are exactly the label sequences
that greedy merging produces, and exactly one of them spells a given word.

The automaton is deterministic over labels, with one state behind each label. Its transition table would have a
row for each state, so it is kept as what the gadgets leave of it, in arrays that are filled once:

  cuts     (u, v) -> rank of the gadget that cut the arc v behind u
  behind   for each label the branches that the state behind it inherits (itself, and down its right-hand
           parts), each up to the rank at which it was born
  begins   for each label the labels it begins with (itself, and down its left-hand parts), each
           from the rank on at which it was longer

A transition (last, label) is missing if a cut between the two lists was made in that time: a table lookup
for each pair, taken for whole arrays of transitions at once.

Encoding splits text as the tokenizer file says (NFC, white space, lower case, its word
pattern), then walks each word's bytes: the byte trie gives the labels that fit, the longest whose
transition exists is taken, and a dead end goes back one arc. That is linear: since one valid path at most spells a given prefix,
a position is entered once at most, so each label that fits somewhere is tried once at most. Words of more than
LONG bytes go forward instead, position by position: of the labels that end at one, the only one whose transition from the
state at its start exists. Decoding emits the arcs' labels, joined by one space when the file names no decoder.

Both directions are one pass without a shuffle. Null text is treated as empty; empty text has no
ids and decodes to empty text; an id without a label is skipped, as the library does. Repeated
rows are encoded alike. Columns other than the text pass through; one named like an output is
replaced.
"""

import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches

#: White space in Unicode's sense, as the tokenizer's pattern engine takes \s.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ROOT = -1
#: Bytes of a word beyond which it is encoded alone.
LONG = 48
#: Bytes of memory that the known chunks of one Python worker may take.
CHUNK_BYTES = 96 << 20


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def ragged(lists: list[list[tuple[int, int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lists of (label, rank) as flat arrays: where each list starts (and the last ends), labels, ranks."""
    ends = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=ends[1:])
    flat = np.array([y for x in lists for y in x], np.int64).reshape(-1, 2)
    return ends, flat[:, 0].copy(), flat[:, 1].copy()


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of counts its index, repeated so often, and the number of the repetition."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


class Automaton:
    """The compiled automaton of one tokenizer file (word-level BPE with an end-of-word mark)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.special: dict[str, int] = {x["content"]: x["id"] for x in spec["added_tokens"]}
        labels = {i: label for label, i in model["vocab"].items()} | {i: label for label, i in self.special.items()}
        self.labels = pa.array([labels.get(i) for i in range(max(labels) + 1)], pa.string())
        self.end = model["end_of_word_suffix"]
        self._read_pattern(spec)
        self._build_gadgets(model)
        self._build_trie(model["vocab"])

    def _read_pattern(self, spec: dict) -> None:
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        pattern = split["pattern"]["Regex"].replace(r"[^\s", f"[^{SPACE}")
        self.words_or_blank = regex.compile(f"{pattern}| ").findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.any_special = [x.encode() for x in self.special]

    def _build_gadgets(self, model: dict) -> None:
        """A gadget cuts one arc, and its label is born: behind it stands what stood behind its right part, and it begins as its left part."""
        ids, always = model["vocab"], 1 << 40
        size = max(ids.values()) + 1
        left, right, born, cuts = [ROOT] * size, [ROOT] * size, [always] * size, {}
        for rank, (a, b) in enumerate(model["merges"]):
            u, v, uv = ids[a], ids[b], ids[a + b]
            cuts[u << 32 | v] = rank
            if born[uv] == always:  # a label is born once; later gadgets that spell it only cut
                left[uv], right[uv], born[uv] = u, v, rank
        cutting, cuttable = {x >> 32 for x in cuts}, {x & 0xFFFFFFFF for x in cuts}

        def down(label: int, part: list[int], wanted: set[int]) -> list[tuple[int, int]]:
            found, time = [], always
            while label != ROOT:
                if label in wanted:
                    found.append((label, time))
                label, time = part[label], born[label]
            return found

        self.behind = ragged([down(t, right, cutting) for t in range(size)])
        self.begins = ragged([down(t, left, cuttable) for t in range(size)])
        self.cuts = Lookup(cuts)

    def _build_trie(self, vocab: dict[str, int]) -> None:
        """steps: (node << 8 | byte) -> node; starts: the nodes at the end of one and two bytes; labels_at: the label that ends at a node, inside a word and at its end."""
        alphabet, goto, ending = byte_alphabet(), {}, ({}, {})
        nodes = 1
        for label, i in vocab.items():
            ends = label.endswith(self.end)
            node = 0
            for c in label[: -len(self.end)] if ends else label:
                at = node << 8 | alphabet[c]
                node = goto.get(at)
                if node is None:
                    goto[at] = node = nodes
                    nodes += 1
            ending[ends][node] = i
        self.steps = Lookup(goto)
        first = self.steps(np.arange(256))
        self.starts = (first, self.steps(np.repeat(first, 256) << 8 | np.tile(np.arange(256), 256)))  # by one byte, and by two
        self.labels_at = np.full((2, nodes), -1, np.int32)
        for row, found in enumerate(ending):
            self.labels_at[row, list(found)] = list(found.values())

    def arcs(self, last: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Whether the state behind each `last` (or the start, ROOT) has the arc `label`."""
        (b0, behind, until), (g0, begins, since) = self.behind, self.begins
        ok = np.ones(len(last), bool)
        rows = np.flatnonzero(last != ROOT)
        last, label = last[rows], label[rows]
        n, m = b0[last + 1] - b0[last], g0[label + 1] - g0[label]
        owner, nth = spread(n * m)
        x, y = b0[last][owner] + nth // m[owner], g0[label][owner] + nth % m[owner]
        rank = self.cuts(behind[x] << 32 | begins[y])
        ok[rows[owner[(rank >= 0) & (rank < until[x]) & (rank <= since[y])]]] = False
        return ok

    def encode_words(self, data: np.ndarray, sizes: np.ndarray, at_once: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in order, and how many each word has. data: the words' bytes, one after another."""
        ends, counts, found = np.cumsum(sizes), np.zeros(len(sizes), np.int64), []
        for i in range(0, len(sizes), at_once):
            some = slice(i, i + at_once)
            long = np.flatnonzero(sizes[some] > LONG)
            ids, counts[some] = self._walk(data, ends[some], sizes[some])
            if len(long):
                alone = [self._forward(data[ends[i + j] - sizes[i + j] : ends[i + j]]) for j in long.tolist()]
                counts[i + long] = [len(x) for x in alone]
                whole, is_long = np.empty(counts[some].sum(), np.int64), np.zeros(len(sizes[some]), bool)
                is_long[long] = True
                where = np.repeat(is_long, counts[some])
                whole[~where], whole[where] = ids, np.concatenate(alone)
                ids = whole
            found.append(ids)
        return np.concatenate(found) if found else np.empty(0, np.int64), counts

    def _walk(self, data: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The paths of all words of up to LONG bytes: all take their next arc, or step back, at the same time."""
        path = np.full((min(LONG, int(sizes.max())), len(sizes)), -1, np.int32)  # labels
        size = np.zeros(path.shape, np.int8)  # their bytes
        steps = np.zeros(len(sizes), np.int64)
        who = np.flatnonzero((sizes > 0) & (sizes <= LONG))
        at, most = (ends - sizes)[who], np.full(len(who), LONG, np.int64)
        while len(who):
            last = np.where(steps[who] > 0, path[steps[who] - 1, who], ROOT).astype(np.int64)
            label, taken = self._next(data, at, ends[who], last, most)
            go = label >= 0
            w = who[go]
            path[steps[w], w], size[steps[w], w] = label[go], taken[go]
            steps[w] += 1
            at[go] += taken[go]
            most[go] = LONG
            back = who[~go]
            steps[back] -= 1
            at[~go] -= size[steps[back], back]
            most[~go] = size[steps[back], back] - 1
            path[steps[back], back] = -1
            left = at < ends[who]
            who, at, most = who[left], at[left], most[left]
        flat = path.T
        return flat[flat >= 0].astype(np.int64), steps

    def _next(self, data, at, stop, last, most) -> tuple[np.ndarray, np.ndarray]:
        """For each word the longest label of up to `most` bytes that fits at `at` and whose arc leaves `last`, and its bytes; or -1."""
        label, taken = np.full(len(at), -1, np.int64), np.zeros(len(at), np.int64)
        fits = list(self._labels(data, at, stop, most))
        for d in range(len(fits), 0, -1):
            rows, new = fits[d - 1]
            open_ = label[rows] < 0
            rows, new = rows[open_], new[open_]
            ok = self.arcs(last[rows], new)
            label[rows[ok]], taken[rows[ok]] = new[ok], d
        return label, taken

    def _labels(self, data, at, stop, most):
        """By their bytes 1, 2, ...: which of the places `at` a label of so many bytes fits, and the label."""
        rows, node, d = np.flatnonzero(most > 0), 0, 0
        while len(rows):
            pos = at[rows] + d
            node = self.steps(node << 8 | data[pos]) if d > 1 else self.starts[1][data[pos - 1].astype(np.int64) << 8 | data[pos]] if d else self.starts[0][data[pos]]
            alive = node >= 0
            rows, node, pos = rows[alive], node[alive], pos[alive]
            d += 1
            at_end = pos + 1 >= stop[rows]
            label = self.labels_at[at_end.astype(np.int64), node]
            yield rows[label >= 0], label[label >= 0].astype(np.int64)
            more = ~at_end & (most[rows] > d)
            rows, node = rows[more], node[more]

    def _forward(self, word: np.ndarray) -> np.ndarray:
        """The path of one long word: all labels that fit anywhere, all transitions between neighbours among them, then one pass over the positions."""
        n = len(word)
        found = [(rows, new, np.full(len(rows), d + 1)) for d, (rows, new) in enumerate(self._labels(word, np.arange(n), np.full(n, n), np.full(n, n)))]
        start, label, size = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(start, kind="stable")
        start, label, stop = start[order], label[order], (start + size)[order]
        first, last = np.searchsorted(start, stop, "left"), np.searchsorted(start, stop, "right")
        before, nth = spread(last - first)  # a label and one that starts where it stops
        after = first[before] + nth
        ok = self.arcs(label[before], label[after])
        order = np.argsort(stop[before[ok]], kind="stable")
        came = np.full(len(label), -2)  # by which label a valid path came to this one
        came[start == 0] = -1
        for a, b in zip(before[ok][order].tolist(), after[ok][order].tolist(), strict=True):
            if came[a] != -2:
                came[b] = a
        path, i = [], next(iter(np.flatnonzero((stop == n) & (came != -2)).tolist()), -1)
        while i >= 0:
            path.append(int(label[i]))
            i = came[i]
        return np.array(path[::-1], np.int64)

    def encode_text(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a text, and how many of them stand before each of its blanks and in all."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3")  # a final sigma is no case of its own here
        parts = self.words_or_blank(text.lower())
        place = {x: i for i, x in enumerate(dict.fromkeys(parts))}
        which = np.fromiter(map(place.__getitem__, parts), np.int64, len(parts))
        place.setdefault(" ", len(place))
        blank = which == place[" "]
        once = [b"" if x == " " else x.encode() for x in place]  # each word is encoded once
        ids, counts = self.encode_words(np.frombuffer(b"".join(once), np.uint8), np.fromiter(map(len, once), np.int64, len(once)))
        owner, nth = spread(counts[which])
        ends = np.concatenate([[0], np.cumsum(counts[which])])
        return ids[(np.cumsum(counts) - counts)[which][owner] + nth], np.append(ends[:-1][blank], ends[-1])

    def encode_piece(self, piece: str) -> np.ndarray:
        """Ids of a text that may have special labels in it."""
        parts = self.cut(piece) if self.cut else [piece]
        return np.concatenate([np.array([self.special[x]]) if i % 2 else self.encode_text(x)[0] for i, x in enumerate(parts)])

    def decode(self, ids: pa.ListArray) -> pa.StringArray:
        """The labels of each list, joined by one space."""
        ends, ids = ids.offsets.to_numpy().astype(np.int64), ids.values.to_numpy(zero_copy_only=False)
        there = (ids >= 0) & (ids < len(self.labels))
        there[there] = self.labels.is_valid().to_numpy(zero_copy_only=False)[ids[there]]
        ends = np.concatenate([[0], np.cumsum(there)])[ends]
        texts = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), self.labels.take(pa.array(ids[there])))
        return pc.binary_join(texts, " ")


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    """Compiled once in each Python worker."""
    return Automaton(path)


class Lookup:
    """A fixed map from 64-bit keys to node numbers, for whole arrays of keys: open addressing, -1 where absent."""

    def __init__(self, items: dict[int, int]):
        self.bits = max(4, (2 * len(items)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        keys, values = np.array(list(items), np.int64), np.array(list(items.values()), np.int64)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            put = np.zeros(len(keys), bool)
            put[first] = True
            put &= free
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            keys, values, slot = keys[~put], values[~put], (slot[~put] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], -1)
        left = np.flatnonzero((there != keys) & (there >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[left]]
            hit = there == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (there >= 0)]
        return out


class Chunks(dict):
    """Packed little-endian 32-bit ids by chunk (what stands between ASCII white space), for the chunks that come again.

    White space always separates words and never composes, so chunks are encoded independently. When
    they take too much memory, only those of the texts at hand stay: the common ones are among them.
    """

    ENTRY = 200  # bytes that an entry takes besides its ids and the chunk

    def __init__(self, path: str, most: int = CHUNK_BYTES):
        super().__init__()
        self.by, self.most, self.size = automaton(path), most, 0

    def put(self, chunk: bytes, ids: bytes) -> None:
        self[chunk] = ids
        self.size += len(chunk) + len(ids) + self.ENTRY

    def learn(self, new: list[bytes]) -> None:
        """Encode chunks that aren't known yet, all at once."""
        by, special = self.by, set()
        if b"<|" in b" ".join(new):
            special = {x for x in new if any(y in x for y in by.any_special)}
            for chunk in special:
                self.put(chunk, by.encode_piece(chunk.decode("utf-8", "replace")).astype("<u4").tobytes())
        plain = [x for x in new if x not in special] if special else new
        if not plain:
            return
        ids, ends = by.encode_text(b" ".join(plain).decode("utf-8", "replace"))
        packed, start = ids.astype("<u4").tobytes(), 0
        for chunk, end in zip(plain, (4 * ends).tolist(), strict=True):
            self[chunk] = packed[start:end]
            start = end
        self.size += len(packed) + sum(map(len, plain)) + self.ENTRY * len(plain)

    def of(self, texts: list[bytes | None]) -> list[bytes]:
        """Packed ids of each text. Chunks are numbered for all texts together, and looked up once each; the ids follow by number."""
        split = pc.ascii_split_whitespace(pa.array([x or b"" for x in texts], pa.binary()).view(pa.string()))
        numbered = split.values.dictionary_encode()
        here, which = numbered.dictionary.view(pa.binary()).to_pylist(), numbered.indices.to_numpy()
        new = [x for x in here if x not in self and x]
        if new:
            if self.size > self.most:
                again = [(x, self[x]) for x in here if x in self]
                self.clear()
                self.size = 0
                for chunk, ids in again:
                    self.put(chunk, ids)
            self.learn(new)
        packed = [self[x] if x else b"" for x in here]  # white space at an end leaves an empty chunk there
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        counts, starts = sizes[which], (np.cumsum(sizes) - sizes)[which]
        ends = np.concatenate([[0], np.cumsum(counts)])
        ids = np.frombuffer(b"".join(packed), "<u4")[np.arange(ends[-1]) + np.repeat(starts - ends[:-1], counts)].tobytes()
        edges = (4 * ends[split.offsets.to_numpy()]).tolist()
        return [ids[a:b] for a, b in zip(edges, edges[1:], strict=False)]


@lru_cache(maxsize=2)
def chunks(path: str) -> Chunks:
    return Chunks(path)


def lists(packed: list[bytes]) -> pa.ListArray:
    ends = np.zeros(len(packed) + 1, np.int32)
    np.cumsum([len(x) // 4 for x in packed], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<i4")))


def recode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs without the text, with its ids as array<int> and, if named, the text that their labels spell: both directions in one pass."""
    bounded_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in (text, ids, decoded, "_bpe_text")]
    more = [T.StructField(decoded, T.StringType())] if decoded else []
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(ids, T.ArrayType(T.IntegerType())), *more])

    def run(batches):
        table = chunks(path)
        for batch in batches:
            found = lists(table.of(batch.column("_bpe_text").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [found] + ([table.by.decode(found)] if decoded else []), names=schema.names)

    return docs.select(*keep, F.col(text).cast("binary").alias("_bpe_text")).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs without the text, with its ids as array<int>."""
    return recode(docs, path, text, ids)


def decode(encoded: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """encoded without the ids, with the text that their labels spell."""
    bounded_batches(encoded.sparkSession)
    keep = [c for c in encoded.columns if c not in (text, ids, "_bpe_ids")]
    schema = T.StructType([encoded.schema[c] for c in keep] + [T.StructField(text, T.StringType())])

    def run(batches):
        by = automaton(path)
        for batch in batches:
            column = batch.column("_bpe_ids")
            ends = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])
            known = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), column.flatten().fill_null(-1).cast(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [by.decode(known)], names=schema.names)

    return encoded.select(*keep, F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("_bpe_ids")).mapInArrow(run, schema)


def op2_bpe(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    path = path or public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ids = F.col("ids")
    return recode(docs, path, decoded="decoded").select(
        "doc_id",
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(ids.cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
