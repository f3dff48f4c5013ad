"""Token ids in flat unsigned integer files with 64-bit document offsets."""

from __future__ import annotations

import gc
import json
import os
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import accumulate, chain, repeat

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import open_fs, sliced, text_or_empty

#: Bytes of text encoded at once, documents returned at once by the reader.
STEP, READ_STEP = 1 << 20, 4096
#: Bytes that a worker's table of words may take, counted as ENTRY for each word and its characters and ids; code points of the longest word in it.
TABLE, ENTRY, LONG = 100 << 20, 200, 64
#: The pre-token pattern whose cuts are known below: letters, single digits, English endings, other marks.
_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ASCII_CUT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
_PLAIN, _PRINTABLE = re.compile(r"[a-z\xdf-\xf6\xf8-\xff]+"), re.compile(r"(?!.*<\|)[!-@\[-~]+")
#: Stands for a null document id in the .doc files.
NO_ID = -(1 << 63)


class WordEncoder:
    """Encodes texts through the tokenizers library, remembering the ids of words seen most, within table bytes.

    Words are cut at spaces and line feeds, which is exact for tokenizers whose pre-tokens never span them;
    that is tested when it is made. ASCII texts are put in lower case first where the tokenizer does so
    itself, and a comma or stop after a letter stands alone, which fewer distinct words result from.
    """

    def __init__(self, path: str, table: int = TABLE) -> None:
        self.table = table
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        same = lambda text, words: self._ids([text])[0] == list(chain.from_iterable(self._ids(words)))
        self.by_word = same("a bc\nthe, of.", ["a", "bc", "the", ",", "of", "."])
        parts = json.loads(self.tokenizer.to_str())
        cut = ((parts["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0].get("pattern")
        kinds = [x["type"] for x in (parts["normalizer"] or {}).get("normalizers", [])]
        self.lower = self.by_word and kinds == ["NFC", "Replace", "Lowercase"] and cut == {"Regex": _CUT}
        if self.lower:  # how the pre-tokenizer writes the bytes of the letters in _PLAIN
            self.letters = {ord(c): self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xDF, 0x100)) if _PLAIN.fullmatch(c)}
            self.model = self.tokenizer.model
            self.marks: dict[str, list[int]] = {}
        self.known: dict[str, int] = {}
        self.base, self.held = 0, 0  # number of words that stay, bytes of all words
        self.starts, self.sizes, self.seen, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _marks(self, word: str) -> list[int]:
        """Ids of a lower-case word of printable ASCII: those of its pre-tokens."""
        found: list[int] = []
        for mark in _ASCII_CUT.findall(word):
            ids = self.marks.get(mark)
            if ids is None:
                ids = [x.id for x in self.model.tokenize(mark)]
                if len(mark) <= 4 and len(self.marks) < 50_000:
                    self.marks[mark] = ids
            found += ids
        return found

    def _ids_of_words(self, words: list[str]) -> list[list[int]]:
        """Ids of words: straight from the model where a word's pre-tokens are plain to see."""
        if not self.lower:
            return self._ids(words)
        ids: list = [None] * len(words)
        rest, tokenize = [], self.model.tokenize
        for i, word in enumerate(words):
            if word.isascii():
                if word.isalpha() and word.islower():
                    ids[i] = [x.id for x in tokenize(word)]
                    continue
                if _PRINTABLE.fullmatch(word):
                    ids[i] = self._marks(word)
                    continue
            elif _PLAIN.fullmatch(word):
                ids[i] = [x.id for x in tokenize(word.translate(self.letters))]
                continue
            rest.append(i)
        for i, found in zip(rest, self._ids([words[i] for i in rest]), strict=True):
            ids[i] = found
        return ids

    def _add(self, words: list[str]) -> None:
        """Ids of words behind those of the table."""
        ids = self._ids_of_words(words)
        sizes = np.fromiter(map(len, ids), np.int32, len(ids))
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(sizes, dtype=np.int64) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.pool = np.concatenate([self.pool, np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))])

    def _cut(self, n: int) -> None:
        """Only the first n entries stay."""
        self.starts, self.sizes = self.starts[:n].copy(), self.sizes[:n].copy()
        self.pool = self.pool[: int(self.sizes.sum(dtype=np.int64))].copy()

    def _cost(self, words: Iterable[str], ids: int) -> int:
        return sum(map(len, words)) + ENTRY * len(self.known) + 4 * ids

    def _forget(self) -> None:
        """Back to the words that the first full table showed to be frequent, the more seen half of it."""
        words = list(self.known)
        if not self.base:
            best = np.sort(np.argsort(-self.seen, kind="stable")[: max(1, len(words) // 2)])
            self.pool = self.pool[_ragged(self.starts[best], self.sizes[best])]
            self.sizes = self.sizes[best]
            self.starts = np.cumsum(self.sizes, dtype=np.int64) - self.sizes
            self.known = {words[i]: n for n, i in enumerate(best.tolist())}
            self.base, self.seen = len(best), np.zeros(0, np.int32)
        for word in words[self.base :] if len(words) == len(self.known) else ():
            del self.known[word]
        self._cut(self.base)
        self.held = self._cost(self.known, len(self.pool))

    def _words(self, text: str) -> list[str]:
        if self.lower and "<|" not in text and (text.isascii() or _is_latin(text)):
            text = text.lower()
            for mark in ",.":  # stands alone between a letter or digit and a space
                parts = text.split(mark + " ")
                if len(parts) > 1:
                    text = "".join(f"{x} {mark} " if x[-1:].isalnum() else f"{x}{mark} " for x in parts[:-1]) + parts[-1]
        return text.replace("\n", " ").split(" ")

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and their number in each text."""
        if not self.by_word:
            ids = self._ids(texts)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            return np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes
        words = [self._words(t) for t in texts]
        flat = list(chain.from_iterable(words))
        codes = np.fromiter(map(self.known.get, flat, repeat(-1)), np.int64, len(flat))
        missed, stay = np.flatnonzero(codes < 0).tolist(), len(self.known)
        if missed:
            missing = [flat[i] for i in missed]
            new = sorted(dict.fromkeys(missing), key=lambda w: len(w) > LONG)  # long words are used here only
            at = dict(zip(new, range(stay, stay + len(new)), strict=True))
            self._add(new)
            codes[missed] = np.fromiter(map(at.__getitem__, missing), np.int64, len(missing))
            short = [w for w in new if len(w) <= LONG]
            self.known.update((w, at[w]) for w in short)
            stay += len(short)
        if not self.base:
            seen = np.bincount(codes, minlength=len(self.sizes))[:stay].astype(np.int32)
            seen[: len(self.seen)] += self.seen
            self.seen = seen
        sizes = self.sizes[codes].astype(np.int64)
        first = np.cumsum([0, *map(len, words)])[:-1]
        found = self.pool[_ragged(self.starts[codes], sizes)], np.add.reduceat(sizes, first)
        if missed:
            if stay < len(self.sizes):
                self._cut(stay)
            self.held += sum(map(len, short)) + ENTRY * len(short) + 4 * int(self.sizes[stay - len(short) :].sum())
            if self.held > self.table:
                self._forget()
        return found


def _is_latin(text: str) -> bool:
    """Whether all code points are below 256, where lower case is the same everywhere."""
    try:
        return text.encode("latin-1") is not None
    except UnicodeEncodeError:
        return False


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of all runs that begin at starts."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


@cache
def encoder(path: str) -> WordEncoder:
    """A worker's encoder of a tokenizer file, which later tasks find with its words."""
    gc.set_threshold(200_000, 50, 50)  # lists of ids are many and hold no cycles
    return WordEncoder(path)


def _with_end(ids: np.ndarray, sizes: np.ndarray, end_id: int) -> np.ndarray:
    return np.insert(ids, np.cumsum(sizes), end_id)


def _writer(tokenizer: str, folder: str, end_id: int, dtype: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        system, path = open_fs(folder)
        out, ids, sizes = None, [], []
        for batch in batches:
            for part in sliced(batch, "text", STEP):
                if out is None:
                    system.create_dir(path, recursive=True)
                    out = system.open_output_stream(f"{path}/{name}.bin")
                tokens, counts = encoder(tokenizer).encode(part.column("text").to_pylist())
                out.write(_with_end(tokens, counts, end_id).astype(dtype).tobytes())
                ids.append(part.column("id").fill_null(NO_ID).to_numpy(zero_copy_only=False).astype("<i8"))
                sizes.append(counts + 1)
        if out is None:
            return
        out.close()
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype("<u8")
        for kind, values in (("doc", np.concatenate(ids)), ("off", offsets)):
            with system.open_output_stream(f"{path}/{name}.{kind}") as f:
                f.write(values.tobytes())
        yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "name": [name], "docs": [len(offsets) - 1], "tokens": [int(offsets[-1])]})

    return run


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Encode every whole text, add end_id to each, and write the ids in ascending id order.

    A range partition of the ids becomes one segment: NAME.bin (ids as little-endian unsigned 16-bit integers,
    32-bit where the vocabulary needs it), NAME.off (64-bit offsets of its documents and its end) and NAME.doc
    (64-bit document ids). manifest.json, returned too, names the segments in order with their bases: the
    prefix sums of their token counts, to be added to offsets. A task that runs again writes other names, so
    the manifest holds whole segments only. Null text is empty (the end id alone), a null id comes first,
    repeated rows stay in text order; an empty table gives no segments. Other columns are not read.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    dtype = "<u2" if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text_or_empty(text_col).alias("text"))
    ordered = rows.repartitionByRange(parts, "id").sortWithinPartitions("id", "text")
    made = sorted(ordered.mapInArrow(_writer(tokenizer, folder, end_id, dtype), "part bigint, name string, docs bigint, tokens bigint").collect())
    bases = [0, *accumulate(x["tokens"] for x in made)]
    manifest = {"dtype": dtype, "tokens": bases[-1], "segments": [{"name": x["name"], "docs": x["docs"], "tokens": x["tokens"], "base": b} for x, b in zip(made, bases)]}
    system, path = open_fs(folder)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def mapped(system: pafs.FileSystem, path: str, dtype: str) -> np.ndarray:
    """A file's integers: memory-mapped where the file system is local, else read."""
    if not system.get_file_info(path).size:
        return np.zeros(0, dtype)
    if isinstance(system, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r")
    with system.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def _reader(folder: str, dtype: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_fs(folder)
        for segment in (x for b in batches for x in b.to_pylist()):
            tokens, offsets, ids = (mapped(system, f"{path}/{segment['name']}.{k}", d) for k, d in (("bin", dtype), ("off", "<u8"), ("doc", "<i8")))
            for at in range(0, len(ids), READ_STEP):
                own, edge = ids[at : at + READ_STEP], offsets[at : at + READ_STEP + 1].astype(np.int64)
                crc = [zlib.crc32(tokens[a:b].astype("<u4").tobytes()) for a, b in zip(edge[:-1], edge[1:], strict=True)]
                columns = [pa.array(own, pa.int64(), mask=own == NO_ID), pa.array(edge[:-1] + segment["base"]), pa.array(np.diff(edge)), pa.array(crc, pa.int64())]
                yield pa.record_batch(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of written files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    system, path = open_fs(folder)
    with system.open_input_stream(f"{path}/manifest.json") as f:
        manifest = json.loads(f.read())
    rows = [(x["name"], x["base"]) for x in manifest["segments"]]
    segments = spark.createDataFrame(rows, "name string, base bigint").repartition(max(1, len(rows)))
    return segments.mapInArrow(_reader(folder, manifest["dtype"]), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def tokens_of(folder: str, segment: dict, dtype: str, index: int) -> np.ndarray:
    """Ids of one document of a segment, without reading the others."""
    system, path = open_fs(folder)
    offsets = mapped(system, f"{path}/{segment['name']}.off", "<u8")
    return mapped(system, f"{path}/{segment['name']}.bin", dtype)[int(offsets[index]) : int(offsets[index + 1])]
