"""The scheme definitions' values once more, for the SQL alone: the library's own tables are not read here.

A row is spellings=class:code points[;class:code points]; the second is that of a vowel where no consonant is before it.
Code points of the common rows are Devanagari's, moved to a language's block; a language's own rows have theirs as they are.
"""

from __future__ import annotations

# The rows that most languages share.
COMMON = """
k=cons:0915
kh/K=cons:0916
g=cons:0917
gh/G=cons:0918
~N=cons:0919
ch=cons:091A
chh/Ch/CH=cons:091B
j=cons:091C
jh/Jh/JH=cons:091D
~n=cons:091E
T=cons:091F
Th/TH=cons:0920
D=cons:0921
Dh=cons:0922
N=cons:0923
t=cons:0924
th=cons:0925
d=cons:0926
dh=cons:0927
n=cons:0928
p=cons:092A
ph/f=cons:092B
b=cons:092C
bh=cons:092D
m=cons:092E
y=cons:092F
r=cons:0930
l=cons:0932
L=cons:0933
v/w=cons:0935
sh/S=cons:0936
Sh/SH=cons:0937
s=cons:0938
h=cons:0939
q=cons:0915 093C
J=cons:091C 093C
x=cons:0915 094D 0937
GY=cons:091C 094D 091E
R=cons:0931
.n/.m=dot:0902
H=dot:0903
.N=dot:0901
.a=dot:093D
OM=special:0950
^=joiner:200D
^^=joiner:200C
/=delim:094D 200C
.h=halanth:094D
.x=nukta:093C
0=digit:0966
1=digit:0967
2=digit:0968
3=digit:0969
4=digit:096A
5=digit:096B
6=digit:096C
7=digit:096D
8=digit:096E
9=digit:096F
a=vowel:;vowel:0905
A/aa=vowel:093E;vowel:0906
i=vowel:093F;vowel:0907
I/ii/ee=vowel:0940;vowel:0908
u=vowel:0941;vowel:0909
U/oo=vowel:0942;vowel:090A
RRi=vowel:0943;vowel:090B
RRI=vowel:0944;vowel:0960
e/E=vowel:0947;vowel:090F
ai=vowel:0948;vowel:0910
o/O=vowel:094B;vowel:0913
au/ou=vowel:094C;vowel:0914
.c=vowel:0945
.C=vowel:0949;vowel:0911
"""
# By language, its block, the common rows it lacks, and its own rows.
LANGUAGES = {
    "hindi": (0x0900, "", ""),
    "marathi": (0x0900, "k q R", "k/q=cons:0915 | RR=cons:0931 | .c=dot:0945 | LLi=vowel:0962;vowel:090C | LLI=vowel:0963;vowel:0961"),
    "nepali": (0x0900, "", ".Da=cons:0921 093C | .Dha=cons:0922 093C | Ya=cons:092F 093C | LLi=vowel:0962;vowel:090C | LLI=vowel:0963;vowel:0961"),
    # the block has no v, no second l, no second r and no chandra signs: b and l are written for the first two
    "bengali": (0x0980, "OM v L R .c .C", "v/w=cons:09AC | L=cons:09B2"),
    "punjabi": (0x0A00, "q Sh x R .a OM RRi RRI .c .C", "khh/Kh=cons:0A16 0A3C | ghh/Gh=cons:0A17 0A3C | x=cons:0A15 0A4D 0A36 | R=cons:0A5C | Fa=cons:0A2B 0A3C | OM=special:0A74 | .a=special:0A71"),
    "gujarati": (0x0A80, "R", ""),  # the block has no second r
    "tamil": (
        0x0B80,
        "k kh g gh ~N ch chh j jh T Th D Dh t th d dh ph b bh q J H .N .a OM .x RRi RRI e o .c .C",
        "k/g=cons:0B95 | ~N/NG=cons:0B99 | c/ch=cons:0B9A | j/jh=cons:0B9C | T/D=cons:0B9F | t/th/d=cons:0BA4 | Nn=cons:0BA9 | f/ph=cons:0B83 0BAA | b=cons:0BAA | zh=cons:0BB4 | J=cons:0B9C | H/q=dot:0B83"
        " | OM=special:0950 | .x=nukta: | e=vowel:0BC6;vowel:0B8E | E=vowel:0BC7;vowel:0B8F | o=vowel:0BCA;vowel:0B92 | O=vowel:0BCB;vowel:0B93",
    ),
    "telugu": (0x0C00, "k q J .N .a OM e o .c .C", "k/q=cons:0C15 | J=cons:0C1C 0CBC | OM=special:0950 | e=vowel:0C46;vowel:0C0E | E=vowel:0C47;vowel:0C0F | o=vowel:0C4A;vowel:0C12 | O=vowel:0C4B;vowel:0C13"),
    "kannada": (0x0C80, "k q .N .a OM e o .c .C", "k/q=cons:0C95 | OM=special:0950 | e=vowel:0CC6;vowel:0C8E | E=vowel:0CC7;vowel:0C8F | o=vowel:0CCA;vowel:0C92 | O=vowel:0CCB;vowel:0C93"),
    "malayalam": (
        0x0D00,
        "k q J .N .a OM RRI e o .c .C",
        "k/q=cons:0D15 | zh=cons:0D34 | OM=special:0950 | RRI=vowel:;vowel:0D60 | LLi=vowel:;vowel:0D0C | LLI=vowel:;vowel:0D61"
        " | e=vowel:0D46;vowel:0D0E | E=vowel:0D47;vowel:0D0F | o=vowel:0D4A;vowel:0D12 | O=vowel:0D4B;vowel:0D13",
    ),
}
#: Languages that end a word's last consonant with a halanth, and those in which ``oum`` is no word of its own.
FINAL_HALANTH = ("tamil", "telugu", "kannada", "malayalam")
NO_OUM = ("bengali",)
#: Languages in which a dot may follow a bare consonant.
FREE_DOT = ("nepali", "punjabi", "telugu")

Row = tuple[list[str], str, str, str | None]


def _row(text: str, base: int) -> Row:
    """(spellings, class, code, code where no consonant is before it)."""
    names, _, forms = text.rpartition("=")
    kinds, codes = zip(*(f.split(":") for f in forms.split(";")), strict=True)
    moved = ["".join(chr(base + c - 0x0900 if base and 0x0900 <= c < 0x0980 else c) for c in (int(x, 16) for x in code.split())) for code in codes]
    return names.split("/") if names != "/" else ["/"], kinds[0], moved[0], moved[1] if len(moved) > 1 else None


def rows(lang: str) -> list[Row]:
    """A language's rows: all but the vowels first, as the definitions have them."""
    base, lacks, own = LANGUAGES[lang]
    common = [_row(line, base) for line in COMMON.strip().splitlines()]
    made = [r for r in common if r[0][0] not in lacks.split()] + [_row(x.strip(), 0) for x in own.split("|") if x.strip()]
    return [r for r in made if r[1] != "vowel"] + [r for r in made if r[1] == "vowel"]


def spelled(lang: str) -> dict[str, Row]:
    """Row by spelling; of rows with one spelling the first is meant."""
    out: dict[str, Row] = {}
    for r in rows(lang):
        for name in r[0]:
            out.setdefault(name, r)
    return out


def native(lang: str) -> dict[str, tuple[str, list[str]]]:
    """(class, spellings) by native code; of rows with one code the last is meant."""
    out: dict[str, tuple[str, list[str]]] = {}
    for names, kind, code, letter in rows(lang):
        for c, k in ((code, "sign" if kind == "vowel" else kind), (letter, kind)):
            if c:
                out[c] = (k, names)
    return out


def halanth(lang: str) -> str:
    return chr(LANGUAGES[lang][0] + 0x4D)
