"""Secret scans: all rules in one automaton, exact spans on the lines it finds."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forumloom.llm.automaton import compile_rules, scan
from forumloom.llm.common import prepare, slices, texts_as_bytes

# Kind, pattern of a whole span, group and least length of that group, pattern whose end the automaton finds.
# The last is contained in every span of its kind that is long enough.
RULES = (
    (
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
        r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6}""",
    ),
    ("access", r"AKIA[A-Z0-9]+", 0, 20, r"AKIA[A-Z0-9]{16}"),
    ("hex", r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24}"),
    ("github", r"gh[oprsu]_[A-Za-z0-9]+", 0, 40, r"gh[oprsu]_[A-Za-z0-9]{4}"),
    ("google", r"AIza[0-9A-Za-z_-]+", 0, 39, r"AIza[0-9A-Za-z_-]{4}"),
    ("slack", r"xox[abprs]-[0-9A-Za-z-]+", 0, 15, r"xox[abprs]-[0-9A-Za-z-]{4}"),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")

_SPAN = T.StructType(
    [T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
)
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """``docs`` with ``spans``: every secret as kind, start and end in code points, by start, then in the order of ``rules``.

    A projection: the automaton, a table of fixed size, goes to each task, reads every byte of the text once and
    marks lines in which a long enough match ends; the spans on those lines are the leftmost
    non-overlapping matches of each rule, less those too short. No rule crosses a line, so other lines
    hold none. Null and empty texts have no spans. Other columns, ``spans`` excepted, are kept.
    """
    spark = prepare(docs)
    shared = spark.sparkContext.broadcast(compile_rules(tuple(r[4] for r in rules)))
    patterns = [(r[0], r[1], r[2], r[3]) for r in rules]
    keep = [c for c in docs.columns if c != "spans"]
    place = keep.index(text)
    frame = docs.select(*[F.col(f"`{c}`") for c in keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(kind, re.compile(p, re.ASCII), group, least) for kind, p, group, least in patterns]

        def lines_of(value: bytes, hits: np.ndarray) -> list[dict]:
            spans, done = [], -1
            chars, upto = 0, 0
            for hit in hits:
                if hit < done:
                    continue
                begin, done = value.rfind(b"\n", 0, hit) + 1, value.find(b"\n", hit)
                done = len(value) if done < 0 else done
                chars += len(value[upto:begin].decode("utf-8"))
                line = value[begin:done].decode("utf-8")
                for order, (kind, pattern, group, least) in enumerate(compiled):
                    for m in pattern.finditer(line):
                        if m.end(group) - m.start(group) >= least:
                            spans.append((chars + m.start(), order, kind, chars + m.end()))
                chars += len(line)
                upto = done
            return [{"kind": kind, "start": start, "end": end} for start, _, kind, end in sorted(spans)]

        for batch in slices(batches, text):
            values = [v or b"" for v in texts_as_bytes(batch.column(place))]
            ends = np.cumsum([len(v) + 1 for v in values])
            hits, _ = scan(shared.value, b"\n".join(values) + b"\n")
            of = np.searchsorted(ends, hits, "right")
            found: list[list[dict]] = [[] for _ in values]
            for i in np.unique(of):
                found[i] = lines_of(values[i], hits[of == i] - (ends[i] - len(values[i]) - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, _SPANS)], names=[*keep, "spans"])

    return frame.mapInArrow(run, T.StructType([*frame.schema.fields, T.StructField("spans", T.ArrayType(_SPAN))]))
