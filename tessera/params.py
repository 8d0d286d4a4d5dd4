"""Default parameters of the scoring operators."""

from __future__ import annotations

from dataclasses import dataclass

# Thresholds and weights that results must agree with.
RISK_HIGH, RISK_MEDIUM = 0.70, 0.40
WEIGHTS_CODE = {"text": 0.35, "code": 0.25, "ai": 0.40}
WEIGHTS_THEORY = {"text": 0.45, "ai": 0.55}
FUSE_TFIDF, FUSE_SEMANTIC = 0.40, 0.60
BLEND_LOCAL, BLEND_EXTERNAL = 0.5, 0.5
BAND_LOW, BAND_HIGH = 0.40, 0.75
TRAIN_MIN_ROWS, TRAIN_MIN_CLASS = 20, 5
LOCKOUT_ATTEMPTS, LOCKOUT_MINUTES = 5, 15
MAX_FILES, MAX_FILE_BYTES = 60, 10 * 1024 * 1024

# The English stop words of the text preparation.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers "
    "herself it its itself they them their theirs themselves what which who whom this that these those am is are "
    "was were be been being have has had having do does did doing a an the and but if or because as until "
    "while of at by for with about against between into through during before after above below to from up down "
    "in out on off over under again further then once here there when where why how all any both each few more "
    "most other some such no nor not only own same so than too very s t can will just don should now"
).split()

# Words that are never an identifier or part of a name on a cover page.
NOT_AN_ID = (
    "class geometry section course semester date department university assignment submission lab instructor faculty "
    "teacher name student id roll reg group title subject report code page table figure algorithm system method "
    "analysis introduction abstract total marks grade theory experiment fall spring summer winter year term "
    "statement program input output solution exercise problem question topic task project function"
).split()

# Substrings that mark a line of source code.
CODE_MARKS = [
    "def ", "class ", "import ", "from ", "public ", "private ", "protected ", "static ", "void ", "int ", "char ",
    "float ", "double ", "bool ", "List<", "Vector<", "#include", "using namespace", "cout <<", "cin >>", "printf(",
    "scanf(", "System.out.println", "return ", "for (", "while (", "if (", "else if", "switch (", "try {", "catch (",
    "finally {", "const ", "self.", "this->", "std::", "#define ", "typedef ", "function ", "var ", "let ", "=>", "lambda ",
]
CODE_STARTS = ["#include", "#define", "#ifdef", "#ifndef", "#pragma", "//", "/*"]
CODE_ENDS = ["{", "}", ";"]


@dataclass(frozen=True)
class TfidfParams:
    max_terms: int = 10_000
    stop_words: tuple[str, ...] = tuple(STOP_WORDS)
