"""Stored states: a checked header around opaque bytes, and state tables as Parquet with their parameters."""

from __future__ import annotations

import json
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = b"SLM1"
VERSION = 1
FAMILIES = {"hll": 1, "cpc": 2, "theta": 3, "tuple": 4, "aod": 5, "linear": 6, "bloom": 7, "countmin": 8, "countsketch": 9, "frequent": 10, "kll": 11, "req": 12, "tdigest": 13, "sample": 14, "varopt": 15, "hybrid": 16, "counting": 17}


class CodecError(ValueError):
    """Bytes that are no state of the family asked for."""


def pack(family: str, body: bytes) -> bytes:
    return MAGIC + struct.pack("<BBI", VERSION, FAMILIES[family], len(body)) + body


def unpack(family: str, data: bytes) -> bytes:
    if len(data) < 10 or data[:4] != MAGIC:
        raise CodecError("not a stored state")
    version, kind, size = struct.unpack_from("<BBI", data, 4)
    if version != VERSION:
        raise CodecError(f"unsupported version {version}")
    if kind != FAMILIES[family]:
        raise CodecError(f"a state of another family than {family}")
    if len(data) != 10 + size:
        raise CodecError("the state is cut short or has bytes left over")
    return data[10:]


#: Columns of the states whose columns are always the same; the others' (tuple, array of doubles, samples) are given.
COLUMNS = {
    "hll": "idx int, rank int", "cpc": "row int, bits long", "linear": "bit int", "hybrid": "part int, idx int, rank int", "theta": "h long, theta long", "bloom": "pos long", "counting": "pos long, n long",
    "countmin": "row int, col int, n long", "countsketch": "row int, col int, n long", "frequent": "item string, n long, offset long, total long",
}


def _tag(parameters: dict) -> bytes:
    return json.dumps(parameters, sort_keys=True).encode()


def to_bytes(state: DataFrame, keys: list[str], family: str, parameters: dict) -> DataFrame:
    """keys.., state binary, memory_usage long: a state table as one value per key, with the checked header and the parameters; equal states give equal bytes. The rows
    of a key are gathered in one place; the family's parameters bound their number."""
    cols = [c for c in state.columns if c not in keys]
    listed = state.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("_rows"))

    def run(batches):
        for b in batches:
            found = []
            for i in range(b.num_rows):
                rows = pa.RecordBatch.from_struct_array(b.column("_rows").slice(i, 1).flatten())
                rows = rows.take(pa.array(range(rows.num_rows), pa.int32()))  # into buffers of its own, without bytes of other rows
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema.with_metadata({"parameters": _tag(parameters)})) as out:
                    out.write_batch(rows)
                found.append(pack(family, sink.getvalue().to_pybytes()))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(found, pa.binary()), pa.array(list(map(len, found)), pa.int64())], [*keys, "state", "memory_usage"])

    return listed.mapInArrow(run, _kinds(state, keys, "state binary, memory_usage long"))


def _kinds(df: DataFrame, keys: list[str], more: str) -> str:
    return ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), more])


def from_bytes(blobs: DataFrame, keys: list[str], family: str, parameters: dict, columns: str | None = None) -> DataFrame:
    """The state table of values made by to_bytes; CodecError (in the task) for bytes of another family, other parameters or no state at all. A null is an empty state."""

    def run(batches):
        for b in batches:
            for i, data in enumerate(b.column("state").to_pylist()):
                if data is None:
                    continue
                try:
                    body = pa.ipc.open_stream(unpack(family, data)).read_all()
                except pa.ArrowInvalid as e:
                    raise CodecError("the state's body cannot be read") from e
                if (body.schema.metadata or {}).get(b"parameters") != _tag(parameters):
                    raise CodecError(f"stored with parameters other than {parameters}")
                for part in body.to_batches():
                    at = pa.array([i] * part.num_rows, pa.int32())
                    yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in keys), *part.columns], [*keys, *part.schema.names])

    return blobs.select(*keys, "state").mapInArrow(run, _kinds(blobs, keys, columns or COLUMNS[family]))


def write_state(state: DataFrame, path: str, family: str, parameters: dict) -> None:
    """The state table with its family, version and parameters in every row (dictionary-encoded, so nearly free)."""
    tag = json.dumps({"family": family, "version": VERSION, "parameters": parameters}, sort_keys=True)
    state.withColumn("_state", F.lit(tag)).write.mode("errorifexists").parquet(path)


def read_state(spark: SparkSession, path: str, family: str, parameters: dict) -> DataFrame:
    """The state table, if it is of this family, version and parameters throughout."""
    tag = json.dumps({"family": family, "version": VERSION, "parameters": parameters}, sort_keys=True)
    rows = spark.read.parquet(path)
    other = rows.where(F.col("_state") != tag).select("_state").limit(1).collect()
    if other:
        raise CodecError(f"stored as {other[0]['_state']}, asked for as {tag}")
    return rows.drop("_state")
