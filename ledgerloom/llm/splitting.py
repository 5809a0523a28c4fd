"""Texts cut into pieces under a limit of tokens at natural boundaries (problem 10).

A text becomes a string with one sign a token: inner tokens of a word, ends of
words, of lines, of paragraphs and of cells.  A regular expression with bounded
quantifiers, its alternatives ordered by the strength of the boundary, takes
runs of up to the limit from it; SQL array functions turn the runs' lengths into
places and reach back for the overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.tokens import Block, blocks_of, bpe, vocabulary_path
from ledgerloom.session import small_batches, written

#: Signs: inside a word, end of a word, of a line, of a paragraph, of a cell.
INSIDE, WORD, LINE, PARAGRAPH, CELL = "i", "w", "l", "p", "c"
#: A word of more tokens is cut into parts of so many characters; into fewer where a part exceeds the least limit, as a character has up to four tokens.
LONG_TOKENS, PART_CHARS, CHAR_TOKENS = 32, 16, 4
#: Texts are read in runs of so many bytes.
SPLIT_BYTES = 1 << 20


def _units(block: Block, coder, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First code point of every unit, and its tokens.

    Units are pre-tokens; white space is cut once more after its last line end,
    and what has many tokens into parts of a few characters, none of more than
    ``least`` tokens.
    """
    long_tokens, few_chars = min(LONG_TOKENS, least), max(1, least // CHAR_TOKENS)
    points, starts = block.points, block.starts
    size = np.fromiter((len(coder.encode_single_piece(w)) for w in block.words), np.int64, len(block.words))
    weight = size[block.slots]
    ends = np.append(starts[1:], len(points))
    text = points.tobytes().decode("utf-32-le")
    has_line = np.zeros(len(block.words), bool)
    for i, w in enumerate(block.words):
        has_line[i] = b"\n" in w and not w.endswith(b"\n")
    known: dict[str, int] = {}

    def tokens(s: str) -> int:
        n = known.get(s)
        if n is None:
            n = known[s] = len(coder.encode_single_piece(s.encode()))
        return n

    extra: dict[int, list[tuple[int, int]]] = {}
    for i in np.flatnonzero(has_line[block.slots] | (weight > long_tokens)):
        a, e = int(starts[i]), int(ends[i])
        word = text[a:e]
        if weight[i] > long_tokens:
            cuts = list(range(0, e - a, PART_CHARS))
            last_line = word.rfind("\n") + 1
            if last_line and last_line < e - a:
                cuts = sorted({*cuts, last_line})
        else:
            cuts = [0, word.rfind("\n") + 1]
        parts = [word[x:y] for x, y in zip(cuts, [*cuts[1:], e - a], strict=True)]
        counts = [tokens(p) for p in parts]
        if max(counts) > least:  # only then into parts that cannot have more
            cuts = [c + x for c, p, n in zip(cuts, parts, counts, strict=True) for x in (range(0, len(p), few_chars) if n > least else (0,))]
            parts = [word[x:y] for x, y in zip(cuts, [*cuts[1:], e - a], strict=True)]
            counts = [tokens(p) for p in parts]
        if len(parts) == 2:  # never less than the whole has
            counts[1] = max(counts[1], int(weight[i]) - counts[0])
        extra[int(i)] = [(a + c, n) for c, n in zip(cuts, counts, strict=True)]
    if not extra:
        return starts, weight
    keep = np.ones(len(starts), bool)
    keep[list(extra)] = False
    more = np.array([x for xs in extra.values() for x in xs], np.int64)
    begin, count = np.concatenate([starts[keep], more[:, 0]]), np.concatenate([weight[keep], more[:, 1]])
    order = np.argsort(begin, kind="stable")
    return begin[order], count[order]


def _signs(batches: Iterator[pa.RecordBatch], path: str, least: int) -> Iterator[pa.RecordBatch]:
    coder = bpe(path)
    for rows, block in blocks_of(batches, "text", SPLIT_BYTES):
        begin, count = _units(block, coder, least)
        end = np.append(begin[1:], len(block.points))
        last = block.points[np.maximum(end - 1, 0)] if len(end) else end
        kind = np.full(len(begin), ord(WORD), np.uint8)
        line = last == 10
        kind[line] = ord(LINE)
        # an empty line: the text before the unit's last line end ends in one too
        white = np.isin(block.points, (9, 10, 11, 12, 13, 32))
        solid = np.maximum.accumulate(np.where(white, -1, np.arange(len(white)))) if len(white) else np.empty(0, np.int64)
        lines = np.concatenate([[0], np.cumsum(block.points == 10)])
        if len(begin):
            back = solid[end - 1] + 1
            kind[line & (lines[end] - lines[back] >= 2)] = ord(PARAGRAPH)
        bounds = block.char_bounds
        cells = rows.column("cell_ends").to_pylist() if "cell_ends" in rows.column_names else [None] * rows.num_rows
        first = np.searchsorted(begin, bounds)
        total = np.concatenate([[0], np.cumsum(count)])
        out_units, out_tokens, out_chars = [], [], []
        for d in range(rows.num_rows):
            a, e = first[d], first[d + 1]
            k = kind[a:e].copy()
            stops = end[a:e] - bounds[d]
            if cells[d] and e > a:
                # the unit that holds a cell's end, or the white space behind it
                at = np.searchsorted(stops, np.asarray([c for c in cells[d] if c is not None], np.int64))
                at = at[at < len(stops)]
                k[at[np.isin(stops[at], cells[d])]] = ord(CELL)
                inside = at[~np.isin(stops[at], cells[d])]
                for near in (inside, inside + 1):  # a cell that ends inside a unit ends with the line that does
                    near = near[near < len(k)]
                    k[near[(k[near] == ord(LINE)) | (k[near] == ord(PARAGRAPH))]] = ord(CELL)
            if e > a:
                k[-1] = ord(CELL)
            signs = np.full(int(total[e] - total[a]), ord(INSIDE), np.uint8)
            here = total[a + 1 : e + 1] - total[a]
            signs[here - 1] = k
            out_units.append(signs.tobytes().decode("ascii"))
            out_tokens.append(here.astype(np.int32))
            out_chars.append(stops.astype(np.int32))
        lists = lambda xs: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in xs])]), pa.int32()), pa.array(np.concatenate(xs) if xs else [], pa.int32()))
        out = rows.drop_columns([c for c in ("cell_ends",) if c in rows.column_names]).append_column("signs", pa.array(out_units)).append_column("unit_tokens", lists(out_tokens)).append_column("unit_chars", lists(out_chars))
        yield from out.combine_chunks().to_batches()


def cutting_pattern(new_tokens: int) -> str:
    """Runs of up to so many tokens that end at the strongest boundary there is, in the second half if it can be."""
    n, half = new_tokens, new_tokens // 2
    ends = (CELL, f"[{PARAGRAPH}{CELL}]", f"[{LINE}{PARAGRAPH}{CELL}]")
    late = [f".{{{half},{n - 1}}}{e}" for e in ends]
    any_ = [f".{{0,{n - 1}}}{e}" for e in ends]
    return "|".join([*late, *any_, f".{{0,{n - 1}}}[^{INSIDE}]", f".{{1,{n}}}"])


def _runs(limits: list[tuple[str, int, int]]) -> Column:
    """Of every limit that the text exceeds, the ends of its runs in tokens."""
    each = []
    for name, most, overlap in limits:
        lengths = F.transform(F.regexp_extract_all("signs", F.lit(f"({cutting_pattern(most - overlap)})"), F.lit(1)), F.length)
        ends = F.aggregate(lengths, F.array().cast("array<int>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(F.element_at(F.concat(F.array(F.lit(0)), acc), -1), F.lit(0)) + x)))
        each.append(F.when(F.length("signs") > most, F.struct(F.lit(name).alias("limit_name"), F.lit(most).alias("most"), F.lit(overlap).alias("overlap"), ends.alias("ends"))))
    return F.filter(F.array(*each), lambda x: x.isNotNull())


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "limit_name", "piece_no", "start_char", "end_char", "n_tokens", "overlap_tokens", "text"]
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
    for b in batches:
        for i in range(b.num_rows):
            doc, text, tokens, chars, runs = (b.column(b.schema.get_field_index(c))[i] for c in ("doc_id", "text", "unit_tokens", "unit_chars", "runs"))
            text, runs = text.as_py(), runs.as_py()
            at, to = np.asarray(tokens.values), np.concatenate([[0], np.asarray(chars.values)])
            edges = np.concatenate([[0], at])
            columns: list[list] = [[] for _ in names]
            for run in runs:
                ends = np.asarray(run["ends"], np.int64)
                begins = np.concatenate([[0], ends[:-1]])
                # the first unit that begins within the overlap before the cut
                first = np.searchsorted(edges, begins - run["overlap"])
                last = np.searchsorted(edges, ends)
                start, stop = to[first], to[last]
                columns[0] += [doc.as_py()] * len(ends)
                columns[1] += [run["limit_name"]] * len(ends)
                columns[2] += range(1, len(ends) + 1)
                columns[3] += start.tolist()
                columns[4] += stop.tolist()
                columns[5] += (edges[last] - edges[first]).tolist()
                columns[6] += (begins - edges[first]).tolist()
                columns[7] += [text[x:y] for x, y in zip(start.tolist(), stop.tolist(), strict=True)]
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def split(documents: DataFrame, limits: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Pieces ``(doc_id, limit_name, piece_no, start_char, end_char, n_tokens, overlap_tokens, text)`` of every text longer than a limit.

    ``n_tokens`` bounds the tokens of the piece from above, and is at most
    ``max_tokens``; ``overlap_tokens`` is what the piece shares with the one
    before, at most that of the limit, rounded to whole words.  Pieces cover the
    text without a gap.  Texts within a limit, null and empty ones have no
    pieces.  The limits are a parameter table: they come to the driver.  The
    pieces are written to the shared folder, as long texts pass in small batches.
    """
    path = vocabulary or vocabulary_path()
    rules = [(r["limit_name"], int(r["max_tokens"]), int(r["overlap_tokens"])) for r in limits.select("limit_name", "max_tokens", "overlap_tokens").collect()]
    for name, most, overlap in rules:
        if not 0 <= overlap <= most - CHAR_TOKENS:
            raise ValueError(f"limit {name}: the overlap must leave room for {CHAR_TOKENS} new tokens, which one character may have")
    if not rules:
        return documents.sparkSession.createDataFrame([], "doc_id long, limit_name string, piece_no int, start_char long, end_char long, n_tokens int, overlap_tokens int, text string")
    cells = F.transform("cells", lambda c: c["end_char"]) if "cells" in documents.columns else F.lit(None).cast("array<bigint>")
    # a text of fewer bytes than the least limit has no more tokens
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), cells.alias("cell_ends")).where(F.octet_length("text") > min(m for _, m, _ in rules))
    signed = docs.mapInArrow(lambda it: _signs(it, path, min(m - o for _, m, o in rules)), "doc_id long, text string, signs string, unit_tokens array<int>, unit_chars array<int>")
    cut = signed.select("doc_id", "text", "unit_tokens", "unit_chars", _runs(rules).alias("runs")).where(F.size("runs") > 0)
    pieces = cut.mapInArrow(_pieces, "doc_id long, limit_name string, piece_no int, start_char long, end_char long, n_tokens int, overlap_tokens int, text string")
    with small_batches(documents.sparkSession):
        return written(pieces, "pieces")
