"""Token counts with the whole-token shortcut.

Offline, on the driver, every vocabulary string that reads as text is encoded alone by
the library; those that come back as exactly one token are proved. The scan splits a text
into the tokenizer's pre-tokens, counts a proved one as one token by a set look-up, and
hands only the rest to the library's merges, remembering each string's count in a bounded
cache. A pre-token is encoded alone as it is in place, because pre-tokens never merge
across their borders.

The shortcut splits with its own pattern and is used only for texts whose characters all
lie below U+0250, where letters, digits and white space are the same in every Unicode
version since 5.1, or in common punctuation; any other text, and any text with a special
string in it, is counted by the library whole. So the counts are the library's for every
text.

The proof and the shortcut hold for byte-level vocabularies without a normaliser; any other
.json goes to the library whole, and a .model file to sentencepiece.

Edge cases: null texts are empty (0 bytes, 0 tokens); repeated rows are counted each; an
empty table gives an empty result; extra columns are ignored. Texts are counted whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The byte-level pre-tokenizer's published splitting pattern: a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters outside this class send the text to the library.
FOREIGN = r"[^\x00-\x1b\x20-\x84\x86-ɏ‐-‧‰-›€]"
#: Distinct merged strings that a worker remembers before it starts anew.
REMEMBER = 200_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def proved(model: str) -> tuple[frozenset[str], list[str] | None]:
    """Vocabulary strings that the library encodes alone as one token; the special strings, None where the split is another."""
    spec = json.loads(model)
    pre = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return frozenset(), None
    tok = library(model)
    special = [a["content"] for a in spec.get("added_tokens", [])]
    ids = sorted(set(tok.get_vocab(with_added_tokens=False).values()))
    strings = sorted({t for t in (tok.decode([i]) for i in ids) if t and "\ufffd" not in t and not any(s in t for s in special)})
    return frozenset(t for t, e in zip(strings, tok.encode_batch_fast(strings, add_special_tokens=False), strict=True) if len(e) == 1), special


def library(model: str):
    """The library's tokenizer, without truncation or padding."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(model)
    tok.no_truncation()
    tok.no_padding()
    return tok


class Counter:
    """Counts tokens of texts in one worker."""

    def __init__(self, model: str, whole: frozenset[str], special: list[str] | None):
        import regex

        self.tok, self.whole, self.special = library(model), whole, special
        self.split, self.foreign = regex.compile(PATTERN).findall, regex.compile(FOREIGN).search
        self.known: dict[str, int] = dict.fromkeys(whole, 1)

    def count(self, text: str) -> int:
        if self.special is None or any(s in text for s in self.special) or self.foreign(text):
            return len(self.tok.encode(text, add_special_tokens=False))
        parts, known = self.split(text), self.known
        try:
            return sum(map(known.__getitem__, parts))
        except KeyError:
            new = list({p for p in parts if p not in known})
            if len(known) > len(self.whole) + REMEMBER:
                self.known = known = dict.fromkeys(self.whole, 1)
                new = list({p for p in parts if p not in known})
            known.update(zip(new, map(len, self.tok.encode_batch_fast(new, add_special_tokens=False)), strict=True))
            return sum(map(known.__getitem__, parts))


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens for every row."""
    spark = docs.sparkSession
    with open(path or default_path(), "rb") as f:
        raw = f.read()
    pieces = (path or "").endswith(".model")
    model = "" if pieces else raw.decode("utf-8")
    sent = spark.sparkContext.broadcast((raw,) if pieces else (model, *proved(model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if pieces:
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_proto=sent.value[0])
            count = lambda t: len(sp.encode(t))
        else:
            count = Counter(*sent.value).count
        for b in batches:
            n = [count(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    picked = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    kind = dict(docs.dtypes)[key]
    return picked.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")


def op9_token_counts(spark, sf_dir: str, limit: int = 1024) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("over_limit", F.col("n_tokens") > limit)
