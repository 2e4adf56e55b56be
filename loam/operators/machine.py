"""Assembling, disassembling and running programs by the column."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.functions import cpu


def assembled(programs: DataFrame) -> DataFrame:
    """(code_id, address, body, error): a program's bytes, or why it has none."""

    def run(frames):
        for frame in frames:
            rows = []
            for code_id, code in zip(frame["code_id"], frame["code"], strict=True):
                try:
                    rows.append((code_id, *cpu.assemble(code or ""), None))
                except cpu.AssemblyError as e:
                    rows.append((code_id, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["code_id", "address", "body", "error"]).astype({"address": "Int64"})

    kind = programs.schema["code_id"].dataType.simpleString()
    return programs.select("code_id", "code").mapInPandas(run, f"code_id {kind}, address long, body binary, error string")


def disassembled(binaries: DataFrame) -> DataFrame:
    """(code_id, address, text) of each instruction of binaries (code_id, address, body)."""

    @F.udf("array<struct<at:int,text:string>>", useArrow=True)
    def listing(body, address):
        return cpu.disassemble(bytes(body), address)

    rows = binaries.where("body is not null").select("code_id", F.explode(listing("body", "address")).alias("l"))
    return rows.select("code_id", F.col("l.at").alias("address"), "l.text")


def simulated(binaries: DataFrame, limit: int = 1000, watch: tuple[int, ...] = ()) -> DataFrame:
    """(code_id, ok, why, steps, a, x, y, p, seen): how a run ended; ok unless it met an unknown code.

    seen: the bytes at the watched addresses.
    """

    def run(frames):
        for frame in frames:
            rows = []
            for code_id, address, body in zip(frame["code_id"], frame["address"], frame["body"], strict=True):
                if body is None:
                    rows.append((code_id, False, "no program", 0, None, None, None, None, []))
                    continue
                m = cpu.Machine(int(address), bytes(body))
                why, steps = m.run(limit)
                rows.append((code_id, why != "illegal", why, steps, m.a, m.x, m.y, m.p, [m.memory[w] for w in watch]))
            yield pd.DataFrame(rows, columns=["code_id", "ok", "why", "steps", "a", "x", "y", "p", "seen"]).astype({k: "Int64" for k in ("a", "x", "y", "p")})

    kind = binaries.schema["code_id"].dataType.simpleString()
    return binaries.select("code_id", "address", "body").mapInPandas(run, f"code_id {kind}, ok boolean, why string, steps int, a long, x long, y long, p long, seen array<int>")
