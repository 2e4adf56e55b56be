"""Tables that results depend on."""

# Mnemonics that open an assembly line in the block detector.
BLOCK_MNEMONICS = "LDA STA JMP JSR LDX LDY ADC SBC RTS CLC SEC INC DEC AND ORA EOR CMP CPX CPY BEQ BNE BCC BCS BPL BMI BVC BVS TAX TAY TXA TYA TSX TXS PHA PLA PHP PLP BRK RTI NOP".split()

# The processor's documented mnemonics, and the cycles each takes at least.
CYCLES = {
    "ADC": 2, "AND": 2, "ASL": 2, "BCC": 2, "BCS": 2, "BEQ": 2, "BIT": 3, "BMI": 2, "BNE": 2, "BPL": 2, "BRK": 7, "BVC": 2, "BVS": 2, "CLC": 2,
    "CLD": 2, "CLI": 2, "CLV": 2, "CMP": 2, "CPX": 2, "CPY": 2, "DEC": 2, "DEX": 2, "DEY": 2, "EOR": 2, "INC": 2, "INX": 2, "INY": 2, "JMP": 3,
    "JSR": 6, "LDA": 2, "LDX": 2, "LDY": 2, "LSR": 2, "NOP": 2, "ORA": 2, "PHA": 3, "PHP": 3, "PLA": 4, "PLP": 4, "ROL": 2, "ROR": 2, "RTI": 6,
    "RTS": 6, "SBC": 2, "SEC": 2, "SED": 2, "SEI": 2, "STA": 3, "STX": 3, "STY": 3, "TAX": 2, "TAY": 2, "TSX": 2, "TXA": 2, "TXS": 2, "TYA": 2,
}

# Conditional branches, and assembler directives.
BRANCHES = "BNE BEQ BPL BMI BCC BCS BVC BVS".split()
DIRECTIVES = "!BYTE !WORD !TEXT !TO !SL !SRC !ZONE !MACRO !ALIGN !FILL".split()

# Words of a line-numbered program that aren't variables.
BASIC_WORDS = "PRINT GOTO GOSUB RETURN IF THEN FOR NEXT STEP INPUT POKE PEEK SYS REM DATA READ RESTORE AND OR NOT TAB SPC TO END STOP CONT LIST RUN NEW LOAD SAVE VERIFY DEF FN DIM LET".split()

# Byte codes of the program format's keywords.
BASIC_TOKENS = dict(
    zip("END FOR NEXT DATA INPUT# INPUT DIM READ LET GOTO RUN IF RESTORE GOSUB RETURN REM".split(), range(0x80, 0x90), strict=True)
) | dict(
    zip(
        "ON WAIT LOAD SAVE VERIFY DEF POKE PRINT# PRINT CONT LIST CLEAR CMD SYS OPEN CLOSE GET NEW TAB( TO FN SPC( THEN NOT STEP + - * / ^ AND OR > = < SGN INT ABS USR FRE POS SQR RND LOG EXP COS SIN TAN ATN PEEK LEN STR$ VAL ASC CHR$ LEFT$ RIGHT$ MID$ GO".split(),
        range(0x91, 0xCC),
        strict=True,
    )
)

# Default keywords of the density gate, and how many distinct ones it asks for.
GATE_WORDS = ["lda", "sta", "ldx", "stx", "jsr", "rts", "poke", "peek", "$d020", "$d021", "$d000", "vic", "sid", "raster", "6502", "6510", "sprite", "kernal", "cia", "assembler", "codice macchina", "linguaggio macchina", "opcode", "mnemonico", "accumulatore", "programmer", "reference", "programmazione"]
GATE_LEAST = 15

# File endings that a scan leaves out.
SKIPPED_ENDINGS = [".gz", ".gzip", ".zip", ".png", ".jpg", ".jpeg", ".gif", ".pdf", ".d64", ".g64", ".prg", ".bin"]

# What a source path must hold (or end with) for its weight; the first that fits counts.
SOURCE_WEIGHTS = [("holds", "knowledge_base/", 3.0), ("holds", "data/src/", 2.0), ("holds", "docs/", 1.5), ("ends", ".md", 1.2), ("holds", "marker_md", 1.2), ("holds", "data/output/", 0.3)]

# Needles of the pair-type rules.
TYPE_RULES = [
    ("instruction", "bugfix", ["wrong", "bug", "problem", "fix", "crash", "not work", "doesn't work"]),
    ("instruction", "theory", ["explain", "how does", "how do", "what is", "what are", "difference between"]),
    ("output", "code", ["lda", "sta", "jsr", "*=", ".byte", "rts", "inc"]),
]

# Needles of the hint labels.
HINTS = [
    ("colour", ["bordo", "border", "$d020", "d020", "colore bordo", "colore dello sfondo", "$d021", "d021", "53280", "53281", "colore", "color"]),
    ("sprite", ["sprite"]),
    ("raster", ["raster", "irq", "$d012", "d012"]),
    ("sound", ["sid", "musica", "suono", "audio", "$d400", "d400", "psid"]),
    ("joystick", ["joystick", "joy", "cia", "$dc00", "dc00", "$dc01", "dc01"]),
    ("kernal", ["kernal", "$ffe0", "chrout", "ffd2", "$ffd2"]),
]

# Needles that tell the kinds of a code block.
ASM_NEEDLES = ["LDA ", "STA ", "JSR ", "RTS", "INX", "LDX ", "LDY ", "STX ", "STY ", "CMP ", "CPX ", "CPY ", "JMP "]
BASIC_NEEDLES = ["PRINT", "GOTO", "POKE"]

# Regions of memory that a program must not touch, system vectors, areas proposed in turn.
CRITICAL = [(0x0000, 0x00FF, "Zero Page"), (0x0100, 0x01FF, "System Stack"), (0x0200, 0x03FF, "System Vectors"), (0x0400, 0x07FF, "Screen Memory / Sprite Pointers"), (0xD000, 0xDFFF, "Hardware I/O Registers")]
VECTORS = [(0x0314, "CINV (IRQ Vector)"), (0x0316, "CBINV (BRK Vector)"), (0x0318, "NMINV (NMI Vector)"), (0xFFFA, "NMI Vector (Hardware)"), (0xFFFC, "RESET Vector"), (0xFFFE, "IRQ/BRK Vector (Hardware)")]
PROPOSED = [0xC000, 0x1000, 0x2000, 0x4000]

# Cycles that the video chip takes from a raster line, and for each sprite on it.
STOLEN_LINE, STOLEN_SPRITE = 43, 2
