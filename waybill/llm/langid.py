"""Language identification by cross-parsing entropy: longest matches in suffix automata of labelled text."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waybill.llm.common import crc_mod, read

#: Labelled documents a language, at most, and characters of them that its automaton holds.
DOCS_A_LANGUAGE = 60
CHARS_A_LANGUAGE = 24_000
#: Characters of all languages together, at most: they share them where there are more than 256. An automaton takes about 33
#: bytes a character, so a model is broadcast with 200 MB at most.
MOST_CHARS = 256 * CHARS_A_LANGUAGE
#: Letters with an id of their own; further ones share the ids that are left.
OWN_LETTERS = 200
LETTERS = 254
#: Characters of a lane. Phrases end at a lane's end, alike in all languages.
LANE = 512
#: Characters that are parsed at once.
BLOCK = 1 << 20


@dataclass
class Automaton:
    """Transitions of states whose rows lie over each other in one array: that of a state s by a code c is at base[s] + c, if it is
    owned by s. So an automaton takes about 12 bytes a transition (at most three a character), however many letters there are."""

    base: np.ndarray
    owner: np.ndarray
    target: np.ndarray

    def root(self, size: int) -> np.ndarray:
        """The first state's transitions by code; -1 where there is none."""
        at = self.base[0] + np.arange(size)
        return np.where(self.owner[at] == 0, self.target[at], -1)


def overlaid(moves: list[dict[int, int]], size: int) -> Automaton:
    """Rows laid into the first gap that takes all their codes, those with most codes first."""
    taken, free = 0, 1
    slots = bytearray([free]) * (2 * sum(map(len, moves)) + 2 * size)
    base = [0] * len(moves)
    at, degree = 0, 0
    for s in sorted(range(len(moves)), key=lambda k: (-len(moves[k]), k)):
        codes = sorted(moves[s])
        if not codes:
            continue
        if len(codes) != degree:  # rows of as many codes find nothing where the last one did not
            at, degree = 0, len(codes)
        at = max(at, codes[0])
        while True:
            if at + 2 * size > len(slots):
                slots += bytearray([free]) * len(slots)
            at = slots.find(free, at)
            if all(slots[at - codes[0] + c] for c in codes):
                break
            at += 1
        base[s] = at - codes[0]
        for c in codes:
            slots[base[s] + c] = taken
    end = max(base) + size
    owner, target = np.full(end, -1, np.int32), np.zeros(end, np.int32)
    for s, row in enumerate(moves):
        for c, to in row.items():
            owner[base[s] + c], target[base[s] + c] = s, to
    return Automaton(np.array(base, np.int32), owner, target)


def suffix_automaton(codes: np.ndarray, size: int) -> Automaton:
    """The automaton of all substrings of ``codes``, which are below ``size``; state 0 begins."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes.tolist():
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return overlaid(moves, size)


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, one after another, and where each begins."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.concatenate(([0], np.cumsum([len(t) for t in lowered]))).astype(np.int64)


def letter_ids(texts: list[str]) -> np.ndarray:
    """An id for each code point: 0 for what is no letter, own ids for the texts' most frequent letters."""
    table = np.fromiter((chr(p).isalpha() for p in range(0x110000)), bool, 0x110000)
    ids = np.zeros(0x110000, np.uint8)
    points = np.arange(0x110000)
    ids[table] = OWN_LETTERS + 1 + points[table] % (LETTERS - OWN_LETTERS)
    seen = Counter(c for t in texts for c in t.lower() if c.isalpha())
    for k, (c, _) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:OWN_LETTERS]):
        ids[ord(c)] = k + 1
    return ids


@dataclass
class Model:
    ids: np.ndarray
    languages: list[str]
    tables: list[Automaton]
    sizes: list[int]

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts' letters, runs of anything else as one 0, and where each text begins."""
        points, first = _points(texts)
        code = self.ids[points]
        begin = np.zeros(len(code) + 1, bool)
        begin[first] = True
        keep = (code != 0) | np.concatenate(([False], code[:-1] != 0))[: len(code)] & ~begin[: len(code)]
        kept = np.concatenate(([0], np.cumsum(keep)))
        return code[keep], kept[first]

    def phrases(self, code: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(text, language): phrases of the greedy parse into longest matches, lanes of all texts in step."""
        lengths = np.diff(first)
        lanes = -(-lengths // LANE)
        owner = np.repeat(np.arange(len(lengths)), lanes)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        start = first[owner] + nth * LANE
        size = np.minimum(LANE, first[owner + 1] - start)
        order = np.argsort(-size, kind="stable")
        owner, start, size = owner[order], start[order], size[order]
        live = np.searchsorted(-size, -np.arange(LANE), "left")  # lanes that are longer than t
        out = np.zeros((len(lengths), len(self.tables)))
        for k, table in enumerate(self.tables):
            root = table.root(LETTERS + 1)
            state, count = np.zeros(len(owner), np.int64), np.zeros(len(owner), np.int64)
            for t in range(LANE):
                n = int(live[t])
                if not n:
                    break
                c = code[start[:n] + t]
                s = state[:n]
                at = table.base[s] + c
                miss = table.owner[at] != s
                again = root[c]
                count[:n] += miss * ((s > 0).astype(np.int64) + (again < 0))
                state[:n] = np.where(miss, np.maximum(again, 0), table.target[at])
            count += state > 0
            out[:, k] = np.bincount(owner, count, len(lengths))
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        names: list[str] = []
        scores = [np.zeros(0)]
        a = 0
        while a < len(texts):
            b, total = a, 0
            while b < len(texts) and (b == a or total + len(texts[b]) <= BLOCK):
                total += len(texts[b])
                b += 1
            code, first = self.codes(texts[a:b])
            letters = np.concatenate(([0], np.cumsum(code != 0)))
            lettered = letters[first[1:]] > letters[first[:-1]]
            if not self.tables:
                names += ["und"] * (b - a)
                scores.append(np.zeros(b - a))
            else:
                bits = self.phrases(code, first) * np.log2(np.array(self.sizes) + 2) / np.maximum(1, np.diff(first))[:, None]
                best = bits.argmin(1)  # of equal ones the first, in the order of names
                odds = np.exp2(4 * (bits.min(1, keepdims=True) - bits))
                names += [self.languages[i] if x else "und" for i, x in zip(best, lettered, strict=True)]
                scores.append(np.where(lettered, 1 / odds.sum(1), 0.0))
            a = b
        return names, np.concatenate(scores)


def shares(lengths: list[int], chars: int) -> list[int]:
    """Characters that texts of these lengths, short ones first, are given of ``chars``: short ones all, the others what is left evenly."""
    given: list[int] = []
    for k, n in enumerate(lengths):
        given.append(min(n, (chars - sum(given)) // (len(lengths) - k)))
    return given


def fit(texts: dict[str, list[str]], chars: int = CHARS_A_LANGUAGE) -> Model:
    """An automaton a language, of ``chars`` characters at most, shared among its texts: short ones are taken whole, of the
    others a span each of what is left for them, from a place that the text's digest draws."""
    used: dict[str, list[str]] = {}
    for language in sorted(texts):
        used[language] = []
        own = sorted(texts[language], key=lambda t: (len(t), t))
        for t, share in zip(own, shares([len(t) for t in own], chars)):
            at = zlib.crc32(t.encode("utf-8", "surrogatepass")) % (len(t) - share + 1)
            used[language].append(t[at : at + share])
    model = Model(letter_ids([t for own in used.values() for t in own]), [], [], [])
    for language, own in used.items():
        code, _ = model.codes([" ".join(own)])
        if len(code):
            model.languages.append(language)
            model.tables.append(suffix_automaton(code, LETTERS + 1))
            model.sizes.append(len(code))
    return model


def train(docs: DataFrame, use: Column, per_language: int = DOCS_A_LANGUAGE, chars: int = CHARS_A_LANGUAGE, most_chars: int = MOST_CHARS) -> Model:
    """A model of at most ``per_language`` documents of each language, those whose key's digest is smallest, where ``use`` holds.

    Only lengths and then the spans that ``fit`` takes come to the driver, ``chars`` characters a language and ``most_chars``
    of all languages, however long the drawn documents are.
    """
    own = docs.where(use & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    at = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")
    counts = own.groupBy("lang").count().collect()
    texts: dict[str, list[str]] = {}
    chars = min(chars, most_chars // max(1, len(counts)))
    if counts:
        spark = docs.sparkSession
        # about four times as many as needed pass, so that the ranking below is over few rows of any language
        most = [(r.lang, min(1 << 32, (4 * per_language << 32) // r["count"] + 1)) for r in counts]
        bound = spark.createDataFrame(most, "lang string, most long")
        drawn = own.select("doc_id", "lang", "text", at.alias("at")).join(F.broadcast(bound), "lang").where("at < most")
        size, crc = F.length("text").cast("long"), F.crc32(F.col("text").cast("binary"))
        # rows of one key by length and digest, so that reruns draw the same text
        first = drawn.groupBy("lang", "at").agg(F.min(F.struct("doc_id", size.alias("size"), crc.alias("crc"))).alias("d"))
        ranked = first.selectExpr("lang", "at", "d.doc_id", "d.size", "d.crc", "row_number() over (partition by lang order by at) as k").where(F.col("k") <= per_language)
        chosen: dict[str, list] = {}
        for r in ranked.orderBy("lang", "size", "at").collect():
            chosen.setdefault(r.lang, []).append(r)
        spans = []
        for rows in chosen.values():
            for r, share in zip(rows, shares([r.size for r in rows], chars)):
                spans.append((r.lang, r.at, r.doc_id, r.size, r.crc, r.crc % (r.size - share + 1) + 1, share))
        wanted = spark.createDataFrame(spans, f"lang string, at long, doc_id {own.schema['doc_id'].dataType.simpleString()}, size long, crc long, start int, share int")
        same = [F.col(f"d.{c}") == F.col(f"w.{c}") for c in ("lang", "at", "size", "crc")] + [F.col("d.doc_id").eqNullSafe(F.col("w.doc_id"))]
        told = own.select("doc_id", "lang", "text", at.alias("at")).join(F.broadcast(wanted.select("lang", "at").distinct()), ["lang", "at"], "left_semi")
        met = told.withColumns({"size": size, "crc": crc}).alias("d").join(F.broadcast(wanted).alias("w"), same)
        cut = met.groupBy("w.lang", "w.at").agg(F.min(F.substring("d.text", F.col("w.start"), F.col("w.share"))).alias("span"))
        for r in cut.orderBy("lang", "at").collect():
            texts.setdefault(r.lang, []).append(r.span)
    return fit(texts, chars)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs``, lang_pred and score, one row per row; of a document only its text is seen, whole.

    Each language's automaton parses the text greedily into the longest phrases that the language's sample holds; a letter
    it doesn't hold is a phrase. Phrases times the bits that name one, by character, are the text's entropy under the
    language, and the least wins, of equals the first by name. Null texts and texts without a letter are ``und`` with score 0;
    repeated rows each get their result; columns named like a result are replaced; an empty table gives no rows.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    at = kept.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = known.value.predict([t or "" for t in batch.column(at).to_pylist()])
            yield pa.record_batch([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*kept, "lang_pred", "score"])

    own = docs.select(*kept)
    return own.mapInArrow(run, T.StructType([*own.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def op6_language(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs, crc_mod(F.col("doc_id"), 5) != 0)
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")
