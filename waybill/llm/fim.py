"""Fill-in-middle: documents cut at two units and rearranged with sentinels, through a rope, and put back from what comes out."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waybill.llm.common import read

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Units of a leaf at most.
LEAF = 256
_UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
_LEAF = re.compile(rf"(?:[\x20\x09-\x0D]*[^\x20\x09-\x0D]+){{1,{LEAF}}}|[\x20\x09-\x0D]+")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


@dataclass(frozen=True, slots=True)
class Rope:
    """A text as a tree: a leaf holds a part of it, an inner node two ropes. Units and code points are counted once, when made."""

    units: int
    points: int
    text: str = ""
    left: Rope | None = None
    right: Rope | None = None

    def leaves(self) -> Iterator[str]:
        open_ = [self]
        while open_:
            node = open_.pop()
            if node.left is None:
                yield node.text
            else:
                open_ += (node.right, node.left)

    def __str__(self) -> str:
        return "".join(self.leaves())


EMPTY = Rope(0, 0)


def leaf(text: str) -> Rope:
    return Rope(len(_WORD.findall(text)) + (text[-1:] in " \t\n\v\f\r" and text != ""), len(text), text)


def joined(*parts: Rope) -> Rope:
    """The ropes one after the other. Units of the parts stay units of their own."""
    out = EMPTY
    for part in parts:
        out = part if not out.points else out if not part.points else Rope(out.units + part.units, out.points + part.points, "", out, part)
    return out


def rope(text: str) -> Rope:
    """A balanced rope; leaves end where units end."""
    nodes = [leaf(m[0]) for m in _LEAF.finditer(text)] or [EMPTY]
    while len(nodes) > 1:
        nodes = [joined(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
    return nodes[0]


def split(node: Rope, rank: int, by_points: bool = False) -> tuple[Rope, Rope]:
    """The first ``rank`` units (or code points) of a rope and the rest: one way down the tree, one leaf cut."""
    before, after = [], []
    while node.left is not None:
        size = node.left.points if by_points else node.left.units
        if rank < size:
            after.append(node.right)
            node = node.left
        else:
            before.append(node.left)
            rank -= size
            node = node.right
    at = rank
    if not by_points:
        ends = [m.end() for _, m in zip(range(rank), _UNIT.finditer(node.text))]
        at = ends[-1] if ends else 0
    return joined(*before, leaf(node.text[:at])), joined(leaf(node.text[at:]), *reversed(after))


def arranged(text: str, one: int, other: int, form: str) -> tuple[str, int, int]:
    """The text cut after so many units and put in the order of ``form``, and the code points of its prefix and middle."""
    low, high = min(one, other), max(one, other)
    head, suffix = split(rope(text), high)
    prefix, middle = split(head, low)
    p, s, m = (Rope(1, len(x), x) for x in (PREFIX, SUFFIX, MIDDLE))
    order = (s, suffix, p, prefix, m, middle) if form == "spm" else (p, prefix, s, suffix, m, middle)
    return str(joined(*order)), prefix.points, middle.points


def put_back(output: str, form: str) -> str:
    """The text that ``output`` was made from. Its parts hold no sentinel, so each sentinel's place is its only one."""
    if form == "plain":
        return output
    whole = rope(output)
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    if not output.startswith(first):
        raise ValueError(f"{form} output begins with another text than {first}")
    parts = []
    for mark in (MIDDLE, second, first):  # from the end, so that places before stay
        at = _find(output, mark, whole.points)
        whole, rest = split(whole, at, True)
        parts.append(split(rest, len(mark), True)[1])
    middle, b, a = parts
    prefix, suffix = (b, a) if form == "spm" else (a, b)
    return str(joined(prefix, middle, suffix))


def _find(output: str, mark: str, end: int) -> int:
    at = output.rfind(mark, 0, end)
    if at < 0:
        raise ValueError(f"{mark} is missing")
    return at


def _drawn(seed: Column, doc_id: Column, k: int) -> Column:
    digest = F.sha2(F.concat(seed, F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """``docs`` with n (units of the text), form, prefix_chars, middle_chars and output.

    Units are words with the white space before them, and white space at the end. Two numbers of a key's digest say after
    how many units the prefix and the middle end, two more say whether the document is rearranged (``percent`` are) and
    how. Texts that are empty or hold a sentinel stay plain. A document is one row's work and takes the memory of its text;
    nothing is shuffled. Defined results: null text is empty; a null doc_id has the digest of an empty key; repeated rows
    and documents of one doc_id are cut alike; own columns named like those added are replaced; an empty table gives no rows.
    """
    new = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())]
    kept = [c for c in docs.columns if c not in [f.name for f in new]]
    own = docs.select(*[F.col(f"`{c}`") for c in kept])
    draws = F.array(*[_drawn(F.lit(str(seed)), F.col("doc_id"), k) for k in range(4)])
    at = kept.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for text, (h1, h2, h3, h4) in zip(batch.column(at).to_pylist(), batch.column(len(kept)).to_pylist(), strict=True):
                text = text or ""
                n = rope(text).units
                if not text or any(x in text for x in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= percent:
                    made.append((n, "plain", None, None, text))
                else:
                    form = "spm" if h4 % 100 < spm_percent else "psm"
                    output, p, m = arranged(text, h1 % (n + 1), h2 % (n + 1), form)
                    made.append((n, form, p, m, output))
            columns = list(zip(*made, strict=True)) or [[]] * len(new)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.record_batch([*batch.columns[: len(kept)], *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=[*kept, *[f.name for f in new]])

    return own.withColumn("_draws", draws).mapInArrow(run, T.StructType([*own.schema.fields, *new]))


def restore(arranged_docs: DataFrame, name: str = "restored") -> DataFrame:
    """``arranged_docs`` (form, output and others) with the exact text that each output was made from, from these two alone."""
    kept = [c for c in arranged_docs.columns if c != name]
    own = arranged_docs.select(*[F.col(f"`{c}`") for c in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [put_back(o, f) for o, f in zip(batch.column(kept.index("output")).to_pylist(), batch.column(kept.index("form")).to_pylist(), strict=True)]
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], names=[*kept, name])

    return own.mapInArrow(run, T.StructType([*own.schema.fields, T.StructField(name, T.StringType())]))


def op11_fim(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    made = fill_in_middle(docs).drop("text").withColumn("output_sha256", F.sha2(F.col("output").cast("binary"), 256))
    return restore(made).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents
), h AS (
  SELECT *, len(u) AS n, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM d
), f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h
), p AS (
  SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS suf FROM f
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
