"""Token ids of whole texts, with a bounded cache of words."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Distinct parts whose ids are kept; the half that was used last stays when there are more.
CACHE_WORDS = 250_000
TOKENIZER = "word_bpe_49k.json"
#: Rows of an Arrow batch of whole texts; both ends of the exchange hold a batch or two.
BATCH_ROWS = 500
#: Characters of one run of texts that is split and looked up at once.
SLICE = 1 << 21
_loaded: dict[str, "WordTokenizer"] = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_LETTERS, _SIGNS = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff", r"!-/:-@\[-`{-~"
#: A word, maybe with signs behind it: two pieces, which normalisation only lower-cases.
_WORD = f"^[A-Z\u00c0-\u00d6\u00d8-\u00de{_LETTERS}]+[{_SIGNS}]*$"
#: Rules under which that pattern holds (fixed values of the public tokenizer file).
_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def _ranges(ids: np.ndarray, size: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs number ``wanted`` of ``ids``, run k being ``size[k]`` long, in a row; and where each ends."""
    count = size[wanted]
    stop = np.cumsum(count)
    place = np.repeat((np.cumsum(size) - size)[wanted] - (stop - count), count)
    place += np.arange(len(place))
    return ids[place], stop


class WordTokenizer:
    """Ids of texts as flat arrays of unsigned 32-bit numbers.

    The tokenizer splits at white space before it merges and drops it, so the
    ids of a text are those of its blank-separated parts in a row. Arrow splits
    the texts, numbers the distinct parts and looks them up among the known
    ones; the rest are encoded once, many in one call. Only the ASCII blanks and
    line ends are used as cuts; any other white space stays inside a part, where
    the tokenizer sees it. A word with signs behind it is cut further, so that a
    word is merged once whatever its capitals and punctuation. Worker processes
    are reused, so the known parts outlive a task.

    All this holds for files with the rules of ``_RULES``; texts of any other
    tokenizer are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.largest = max(vocabulary.values(), default=0)
        rules = json.loads(self.tokenizer.to_str())
        model = rules["model"]
        self.by_parts = all(rules[k] == v for k, v in _RULES.items()) and all("<|" in t["content"] for t in rules["added_tokens"]) and model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout")
        self.words, self.round = pa.array([], pa.large_string()), 0
        self.ids, self.sizes, self.used = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)
        #: Ids that close a piece.
        self.closes = np.zeros(self.largest + 1, dtype=bool)
        self.closes[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True

    def _whole(self, some: list[str]) -> Iterator[np.ndarray]:
        for k in range(0, len(some), 4096):
            for e in self.tokenizer.encode_batch_fast(some[k : k + 4096], add_special_tokens=False):
                yield np.array(e.ids, dtype="<u4")

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for each piece; many pieces are one text, and closing ids tell them apart again."""
        ids, sizes, texts = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)], pieces.to_pylist()
        for k in range(0, len(texts), 8192):
            some = texts[k : k + 8192]
            got = np.concatenate(list(self._whole([" ".join(some[i : i + 64]) for i in range(0, len(some), 64)])))
            size = np.diff(np.flatnonzero(self.closes[got]), prepend=-1)
            if len(size) != len(some):
                each = list(self._whole(some))
                got, size = np.concatenate(each), np.array(list(map(len, each)))
            ids.append(got)
            sizes.append(size)
        return np.concatenate(ids), np.concatenate(sizes)

    def _parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for each part."""
        if not len(parts):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        simple = pc.match_substring_regex(parts, _WORD)
        low = pc.utf8_lower(parts.filter(simple))
        units = pa.concat_arrays([pc.replace_substring_regex(low, f"[{_SIGNS}]+$", ""), pc.replace_substring_regex(low, f"^[{_LETTERS}]+", "")]).dictionary_encode()
        ids, size = self._pieces(units.dictionary.filter(pc.not_equal(units.dictionary, "")))
        full = pc.not_equal(units.dictionary, "").to_numpy(zero_copy_only=False)
        all_sizes = np.zeros(len(full), np.int64)
        all_sizes[full] = size
        pairs = units.indices.to_numpy().reshape(2, -1).T.reshape(-1)
        ids, stop = _ranges(ids, all_sizes, pairs)
        size = np.diff(stop[1::2], prepend=0)
        odd = list(self._whole(parts.filter(pc.invert(simple)).to_pylist()))
        if not odd:
            return ids, size
        is_simple = simple.to_numpy(zero_copy_only=False)
        order = np.empty(len(parts), np.int64)
        order[is_simple], order[~is_simple] = np.arange(len(size)), len(size) + np.arange(len(odd))
        size = np.concatenate([size, list(map(len, odd))])
        return _ranges(np.concatenate([ids, *odd]), size, order)[0], size[order]

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and ``len(texts) + 1`` offsets into them."""
        if not self.by_parts:
            each = list(self._whole(texts))
            return np.concatenate([np.zeros(0, "<u4"), *each]), np.cumsum([0, *map(len, each)])
        rows = pa.array(texts, pa.large_string())
        for blank in "\n\t\r":
            rows = pc.replace_substring(rows, blank, " ")
        split = pc.split_pattern(rows, " ")
        numbered = split.values.dictionary_encode()
        at = pc.index_in(numbered.dictionary, value_set=self.words)
        fresh = numbered.dictionary.filter(at.is_null())
        ids, size = self._parts(fresh)
        at = at.fill_null(-1).to_numpy().astype(np.int64)
        at[at < 0] = len(self.words) + np.arange(len(fresh))
        self.words = pa.concat_arrays([self.words, fresh])
        self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, size])
        self.used = np.concatenate([self.used, np.zeros(len(fresh), np.int64)])
        self.round += 1
        self.used[at] = self.round
        out, stop = _ranges(self.ids, self.sizes, at[numbered.indices.to_numpy()])
        if len(self.words) > CACHE_WORDS:
            keep = np.sort(np.argsort(-self.used, kind="stable")[: CACHE_WORDS // 2])
            self.words, self.used = self.words.take(pa.array(keep)), self.used[keep]
            self.ids, self.sizes = _ranges(self.ids, self.sizes, keep)[0], self.sizes[keep]
        return out, np.append(0, stop)[split.offsets.to_numpy()]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes."""
        ids, cuts = self.encode_flat(texts)
        data, cuts = ids.tobytes(), (4 * cuts).tolist()
        return [data[i:j] for i, j in zip(cuts, cuts[1:])]


def word_tokenizer(path: str) -> WordTokenizer:
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def slices(texts: Iterable[str | None], size: int = SLICE):
    """Runs of rows of about ``size`` characters; null counts as empty."""
    rows, total = [], 0
    for t in texts:
        rows.append(t or "")
        total += len(rows[-1])
        if total >= size:
            yield rows
            rows, total = [], 0
    if rows:
        yield rows


@contextmanager
def text_batches(spark: SparkSession, rows: int = BATCH_ROWS):
    """Small Arrow batches for the jobs that run inside; texts can be long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)
