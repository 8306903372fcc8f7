"""Token counts (operator 8) and token ids by public vocabularies.

Encoding runs in Arrow functions on batches of about equal bytes; only lengths leave the task. Long texts are
first cut where no token can reach across, so one long text neither fills a batch nor a task's memory.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm import kernels as K

# Bytes of text encoded at a time, and the length from which a text is cut.
BATCH_BYTES = 1 << 20
PIECE_CHARS = 1 << 15


def public_path(name: str) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Counter:
    """Lengths of texts in tokens, without begin, end or added special tokens.

    ``join``: what a cut swallows. With sentencepiece a cut falls on a space after a character that is no
    space; the next part then gets its space back as the prefix that the library puts before each text. With
    a byte-level file a cut falls before such a space when a letter follows. Both hold only for vocabularies
    as checked in the constructor; other files are encoded in whole texts.
    """

    def __init__(self, path: str):
        self.cut: re.Pattern | None = None
        self.swallow = 0
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
            pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
            bounded = not any("▁" in p.lstrip("▁") for p in pieces)
            if bounded and model.encode("a", out_type=str)[0][0] == "▁" and model.encode("a  b") != model.encode("a b"):
                self.cut, self.swallow = re.compile(r"(?<=[^ ▁]) (?=.)", re.DOTALL), 1
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self.encode = lambda texts: [len(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            if "ByteLevel" in repr(tokenizer.pre_tokenizer) and tokenizer.normalizer is None:
                self.cut = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")

    def parts(self, text: str) -> Iterator[str]:
        """The text, cut at safe places at least PIECE_CHARS apart."""
        start = 0
        while self.cut and len(text) - start > 2 * PIECE_CHARS:
            at = self.cut.search(text, start + PIECE_CHARS)
            if not at:
                break
            yield text[start : at.start()]
            start = at.start() + self.swallow
        yield text[start:]


def byte_batches(parts: Iterator[tuple[int, str]], most: int = BATCH_BYTES) -> Iterator[list[tuple[int, str]]]:
    """Group (row, text) into batches of about ``most`` characters."""
    batch, size = [], 0
    for row, text in parts:
        if batch and size + len(text) > most:
            yield batch
            batch, size = [], 0
        batch.append((row, text))
        size += len(text)
    if batch:
        yield batch


def _count_batches(path_of: Callable[[], str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path_of())
        for batch in batches:
            texts = batch.column("text")
            counts = [0] * batch.num_rows
            parts = ((i, p) for i in range(batch.num_rows) if (t := texts[i].as_py()) for p in counter.parts(t))
            for group in byte_batches(parts):
                for (row, _), n in zip(group, counter.encode([t for _, t in group])):
                    counts[row] += n
            kept = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "text"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(counts, pa.int64())], [n for n in batch.schema.names if n != "text"] + ["n_tokens"])

    return run


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_tokens) per row of ``docs``.

    ``vocabulary`` is a public file's name or an absolute path. Null and empty texts have 0 bytes and 0 tokens;
    rows with a null or repeated key give one row each; other columns are not read.
    """
    path_of = (lambda: vocabulary) if vocabulary.startswith("/") else (lambda: public_path(vocabulary))
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    rows = rows.select("key", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    kind = rows.schema["key"].dataType.simpleString()
    counted = rows.mapInArrow(K.thrifty(_count_batches(path_of)), f"key {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("key").alias(key), "n_bytes", "n_tokens")
