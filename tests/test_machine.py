"""Assembler, disassembler and simulator."""

from __future__ import annotations

import pytest

from loam.functions import cpu
from loam.operators import machine


def ran(code, limit=1000):
    m = cpu.Machine(*cpu.assemble(code))
    return m, m.run(limit)


def test_bytes():
    assert cpu.assemble("* = $c000\nlda #$01 ; x\nsta $d020\nloop: jmp loop") == (0xC000, bytes.fromhex("A901 8D20D0 4C05C0"))
    assert cpu.assemble("v = $fb\n lda (v),y\n sta v,x\n ldx v,y\n lda <later\nlater: rts")[1] == bytes.fromhex("B1FB 95FB B6FB AD0A00 60")
    assert cpu.assemble("!byte 1,$ff\n!word $1234\nrol\nrol a\ninc $12")[1] == bytes.fromhex("01FF 3412 2A 2A E612")
    for bad in ("foo", "lda", "bne away", "bne x\n" + "nop\n" * 200 + "x: rts", "jmp (1,2"):
        with pytest.raises(cpu.AssemblyError):
            cpu.assemble(bad)


def test_every_code_returns():
    codes, names = cpu.tables()
    assert len(codes) == len(names) == 151
    for code, (_, mode) in names.items():
        body = bytes([code, 0x12, 0x34][: cpu.SIZES[mode]])
        text = cpu.disassemble(body, 0x1000)[0][1]
        assert cpu.assemble(f"*=$1000\n{text}")[1] == body, text
    assert cpu.disassemble(b"\x02\xa9", 5) == [(5, "!byte $02"), (6, "!byte $A9")]


def test_runs():
    m, (why, _) = ran("ldx #5\nlda #0\nadd: clc\nadc #3\ndex\nbne add\nsta $02\nrts")
    assert (why, m.memory[2], m.x) == ("returned", 15, 0)
    m, (why, _) = ran("jsr f\nsta $03\nrts\nf: lda #$7f\nadc #1\nrts")
    assert why == "returned" and m.memory[3] == 0x80 and m.p >> 6 & 1 == 1
    assert ran("here: jmp here")[1] == ("loop", 1)
    assert ran("l: inx\njmp l", 50)[1] == ("limit", 50)
    assert ran("!byte $02")[1] == ("illegal", 1)
    m, _ = ran("sec\nlda #5\nsbc #7\nphp\npla\nrts")
    assert m.a & 0x81 == 0x80
    m, _ = ran("lda #$81\nasl\nrol $10\nror\nlsr\nrts")
    assert (m.a, m.memory[0x10], m.p & 1) == (0, 1, 1)


def test_columns(spark):
    df = spark.createDataFrame([(1, "lda #1\nsta $02\nrts"), (2, "oops"), (3, None)], "code_id int, code string")
    made = machine.assembled(df)
    rows = {r["code_id"]: r for r in made.collect()}
    assert rows[1]["address"] == 0x0801 and rows[1]["error"] is None and rows[2]["body"] is None and "oops" in rows[2]["error"].lower()
    assert [(r["address"], r["text"]) for r in machine.disassembled(made.where("code_id = 1")).orderBy("address").collect()] == [(0x0801, "LDA #$01"), (0x0803, "STA $02"), (0x0805, "RTS")]
    got = {r["code_id"]: (r["ok"], r["why"], r["seen"]) for r in machine.simulated(made, watch=(2,)).collect()}
    assert got[1] == (True, "returned", [1]) and got[2] == (False, "no program", [])
