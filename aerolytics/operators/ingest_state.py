"""What a split of recording lines knows about its recordings, and how splits add up.

``split_state`` reads a partition of lines once and gives small rows: per batch,
recording and cell position the counts and bounds every typing decision needs
(``cell``), per partition and recording the range of its lines (``run``), and the
few lines that may turn out to be the header (``line``): a split that does not
begin a recording cannot know. Rows of one kind merge by sum, least and largest,
so a recording of any length needs no line to leave its split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from aerolytics.functions.numbers import INFINITY_PATTERN, NUMBER_PATTERN
from aerolytics.functions.text import PY_WHITESPACE
from aerolytics.functions.timestamps import SHAPES, TS_RANGE

NF = len(SHAPES)
#: Columns of a state row: which kind, where, and the mergeable counts.
STATE = ("kind string, part int, flight_id string, pos long, line_no long, last_no long, seq long, ordered boolean, "
         "blank boolean, line string, n_data long, "
         + ", ".join(f"cnt{i} long, min{i} long, max{i} long, num{i} long" for i in range(NF)))
_DAY = 86_400_000_000
_YEAR_1900 = int(np.datetime64("1900-01-01", "us").astype(np.int64))
_RANGE = [int(np.datetime64(t.replace(" ", "T"), "us").astype(np.int64)) for t in TS_RANGE]
# The fields of each shape as capture groups.
_FIELDS = [r"^(?P<d>[0-9]+):(?P<h>[0-9]+):(?P<m>[0-9]+):(?P<s>[0-9]+)\.(?P<f>[0-9]+)$",
           r"^(?P<y>[0-9]+)-(?P<o>[0-9]+)-(?P<d>[0-9]+) +(?P<h>[0-9]+):(?P<m>[0-9]+):(?P<s>[0-9]+)\.(?P<f>[0-9]*)$",
           r"^(?P<y>[0-9]+)-(?P<o>[0-9]+)-(?P<d>[0-9]+) +(?P<h>[0-9]+):(?P<m>[0-9]+):(?P<s>[0-9]+)$",
           r"^(?P<h>[0-9]+):(?P<m>[0-9]+):(?P<s>[0-9]+)\.(?P<f>[0-9]+)$",
           r"^(?P<h>[0-9]+):(?P<m>[0-9]+):(?P<s>[0-9]+)$"]


def timestamps(cells: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(format index or -1, microseconds since 1970) of stripped timestamp cells; -1 where no time results."""
    kind = np.full(len(cells), -1)
    micros = np.zeros(len(cells), np.int64)
    for i, shape in enumerate(SHAPES):
        at = np.flatnonzero(pc.match_substring_regex(cells, shape).to_numpy(zero_copy_only=False) & (kind < 0))
        if not len(at):
            continue
        parts = pc.extract_regex(cells.take(pa.array(at)), _FIELDS[i])
        field = {parts.type.field(k).name: parts.field(k) for k in range(parts.type.num_fields)}
        whole = {k: pc.cast(v, pa.int64()).to_numpy(zero_copy_only=False) for k, v in field.items() if k != "f"}
        clock = (whole["h"] * 3600 + whole["m"] * 60 + whole["s"]) * 1_000_000
        if "f" in field:
            six = pc.utf8_rpad(pc.utf8_slice_codeunits(field["f"], 0, 6), 6, "0")
            clock += pc.cast(six, pa.int64()).to_numpy(zero_copy_only=False)
        ok = (whole["h"] <= 23) & (whole["m"] <= 59) & (whole["s"] <= 61)
        if "y" in field:
            month, day = whole["o"], whole["d"]
            ok &= (month >= 1) & (month <= 12) & (day >= 1)
            first = ((whole["y"] - 1970) * 12 + np.clip(month, 1, 12) - 1).astype("datetime64[M]")
            length = ((first + 1).astype("datetime64[D]") - first.astype("datetime64[D]")).astype(np.int64)
            ok &= day <= length
            value = (first.astype("datetime64[D]").astype(np.int64) + day - 1) * _DAY + clock
            ok &= (value >= _RANGE[0]) & (value <= _RANGE[1])
        else:
            value = _YEAR_1900 + clock
            if "d" in field:
                ok &= (whole["d"] >= 1) & (whole["d"] <= 366)
                value = value + (whole["d"] - 1) * _DAY
        kind[at[ok]], micros[at[ok]] = i, value[ok]
    return kind, micros


def numeric_cells(cells: pa.Array) -> np.ndarray:
    """Which stripped cells are numbers: plain decimals that do not overflow, or a spelled-out infinity."""
    ok = pc.match_substring_regex(cells, NUMBER_PATTERN).to_numpy(zero_copy_only=False).copy()
    # Only an exponent or hundreds of digits can overflow.
    large = ok & (pc.match_substring_regex(cells, "[eE]").to_numpy(zero_copy_only=False)
                  | (pc.utf8_length(cells).to_numpy(zero_copy_only=False) > 300))
    for i in np.flatnonzero(large).tolist():
        ok[i] = abs(float(cells[i].as_py())) != float("inf")
    return ok | pc.match_substring_regex(cells, INFINITY_PATTERN).to_numpy(zero_copy_only=False)


def _row_batch(**columns) -> pa.RecordBatch:
    """A batch of STATE rows from the given columns, null elsewhere."""
    n = len(next(iter(columns.values())))
    types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
    fields = [f.split() for f in STATE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[c], types[t]) if c in columns else pa.nulls(n, types[t])
                                       for c, t in fields], [c for c, _ in fields])


def _cell_rows(part: np.ndarray, flight: pa.Array, line: pa.Array) -> pa.RecordBatch:
    """``cell`` rows of data lines: counts per partition, recording and position."""
    lists = pc.split_pattern(line, ",")
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    widths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    starts = np.cumsum(widths) - widths
    cells = pc.utf8_trim(lists.flatten(), PY_WHITESPACE)
    kind, micros = timestamps(cells.take(pa.array(starts)))
    dictionary = pc.dictionary_encode(flight)
    code = dictionary.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    group = code * (int(part.max()) + 1) + part
    names, group = np.unique(group, return_inverse=True)
    width = int(widths.max())
    pos = np.arange(int(widths.sum())) - np.repeat(starts, widths)
    slot = np.repeat(group, widths) * width + pos
    n = len(names) * width
    columns = {"n_data": np.bincount(slot, minlength=n)}
    cell_kind = np.repeat(kind, widths)
    typed = np.flatnonzero((cell_kind >= 0) & (pos > 0))
    good = typed[numeric_cells(cells.take(pa.array(typed)))] if len(typed) else typed
    for i in range(NF):
        rows = np.flatnonzero(kind == i)
        at = group[rows] * width
        low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
        np.minimum.at(low, at, micros[rows])
        np.maximum.at(high, at, micros[rows])
        count = np.bincount(at, minlength=n)
        columns[f"cnt{i}"] = count
        columns[f"min{i}"] = pa.array(low, mask=count == 0)
        columns[f"max{i}"] = pa.array(high, mask=count == 0)
        columns[f"num{i}"] = np.bincount(slot[good[cell_kind[good] == i]], minlength=n)
    used = pa.array(np.flatnonzero(columns["n_data"]))
    owner = np.repeat(names, width)
    flights = dictionary.dictionary.take(pa.array(owner // (int(part.max()) + 1)))
    out = _row_batch(kind=["cell"] * n, part=(owner % (int(part.max()) + 1)).astype(np.int32), flight_id=flights,
                     pos=np.tile(np.arange(width), len(names)), **columns)
    return out.take(used)


def split_state(lines: DataFrame) -> DataFrame:
    """STATE rows of ``lines`` (flight_id, line_no, line, blank), read once."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        # Per recording: first and last line number, in order so far, place of its lines among the partition's
        # recordings, whether a line with text was seen, whether the line after that one is still to come.
        runs: dict[str, list] = {}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            flight, line = batch.column(0), batch.column(2)
            encoded = pc.dictionary_encode(flight)
            names, code = encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False)
            no, blank = (batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 3))
            loose = np.zeros(n, bool)
            cuts = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), n]
            for a, b in zip(cuts[:-1], cuts[1:]):
                name = flight[a].as_py()
                run = runs.get(name)
                inner = bool((np.diff(no[a:b]) > 0).all())
                if run is None:
                    run = runs[name] = [int(no[a]), int(no[b - 1]), inner, len(runs), False, False]
                    loose[a] = True
                else:
                    # Contiguous only if no other recording came between.
                    run[2] &= inner and no[a] > run[1] and run[3] == len(runs) - 1
                    run[0], run[1] = min(run[0], int(no[a:b].min())), max(run[1], int(no[a:b].max()))
                    loose[a] |= run[5]
                    run[5] = False
                if not run[4]:
                    text = np.flatnonzero(~blank[a:b])
                    if len(text):
                        run[4] = True
                        loose[a + text[0]] = True
                        run[5] = a + text[0] + 1 >= b
                        loose[a + text[0] + 1:min(b, a + text[0] + 2)] = True
            at = np.flatnonzero(loose)
            yield _row_batch(kind=["line"] * len(at), part=np.full(len(at), part, np.int32), flight_id=flight.take(pa.array(at)),
                             line_no=no[at], line=line.take(pa.array(at)), blank=blank[at])
            data = np.flatnonzero(~loose & ~blank)
            if (~blank).any():  # the last line with text per recording
                last = np.full(int(code.max()) + 1, -1, np.int64)
                np.maximum.at(last, code[~blank], no[~blank])
                ends = np.flatnonzero(last >= 0)
                yield _row_batch(kind=["end"] * len(ends), part=np.full(len(ends), part, np.int32),
                                 flight_id=names.take(pa.array(ends)), line_no=last[ends])
            if len(data):
                yield _cell_rows(np.full(len(data), part), flight.take(pa.array(data)), line.take(pa.array(data)))
        if runs:
            first, last, ordered, seq, _, _ = zip(*runs.values())
            yield _row_batch(kind=["run"] * len(runs), part=np.full(len(runs), part, np.int32), flight_id=list(runs),
                             line_no=first, last_no=last, ordered=ordered, seq=seq)

    return lines.select("flight_id", "line_no", "line", "blank").mapInArrow(read, STATE)


def line_state(lines: DataFrame) -> DataFrame:
    """``cell`` rows of known data lines (part, flight_id, line)."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _cell_rows(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1), batch.column(2))

    return lines.select("part", "flight_id", "line").mapInArrow(read, STATE)
