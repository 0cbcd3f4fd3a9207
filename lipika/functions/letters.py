"""Native letters of each language: their properties, and the ways to type them in Latin letters.

A producer is (pattern, options). Patterns name classes and letters in braces: ``{k}`` is a letter,
``{cons}`` all letters with a property, ``{own}`` the letter itself, which is group 1.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

from .rules import LANGUAGES

#: Stands for a letter that adds nothing, while a word is trained on or predicted.
EPSILON = "\ue000"

# Places of letters in an Indic block.
CONSONANTS = "k:15 kh:16 g:17 gh:18 ~N:19 ch:1a Ch:1b j:1c jh:1d ~n:1e T:1f Th:20 D:21 Dh:22 N:23 t:24 th:25 d:26 dh:27 n:28 Nn:29 p:2a ph:2b b:2c bh:2d m:2e y:2f r:30 R:31 l:32 L:33 zh:34 v:35 sh:36 Sh:37 s:38 h:39"
VOWELS = "a:05 A:06 i:07 I:08 u:09 U:0a RRi:0b LLi:0c e^:0d e:0e E:0f ai:10 o^:11 o:12 O:13 au:14 RRI:60"
SIGNS = "A0:3e i0:3f I0:40 u0:41 U0:42 RRi0:43 RRI0:44 e^0:45 e0:46 E0:47 ai0:48 o^0:49 o0:4a O0:4b au0:4c LLi0:62"
OTHERS = ".N:01 .n:02 H:03 nukta:3c halanth:4d OM:50"

# Letters that a language does not type, though its block may have them.
LEFT_OUT = {
    "hindi": "Nn R zh LLi e^ e o^ o RRI RRI0 e0 o0 LLi0",
    "marathi": "Nn R zh e^ e o^ o RRI RRI0 e0 o0",
    "nepali": "Nn R zh L LLi e^ e o^ o RRI RRI0 e0 o0 LLi0",
    "bengali": "Nn R zh OM",
    "punjabi": "Nn R zh OM",
    "gujarati": "Nn R zh LLi e o LLi0 OM",
    "tamil": "sh OM",
    "telugu": "LLi LLi0 zh .N",
    "kannada": "R zh LLi LLi0 .N",
    "malayalam": "LLi LLi0 .N Nn OM",
}
# A consonant's typed forms where they are not its name in small letters.
TYPED = {"~N": ["n"], "Ch": ["ch"], "~n": ["ny", "n"], "T": ["t"], "Th": ["th"], "D": ["d"], "Dh": ["dh"], "N": ["n"], "Nn": ["n"], "t": ["t", "th"], "ph": ["f"], "R": ["r"], "L": ["l"], "Sh": ["sh"]}
# Properties by letter, in the order in which they group letters.
GROUPS = {
    "cons1": "k kh g gh ~N",
    "cons2": "ch Ch j jh ~n",
    "cons3": "T Th D Dh N",
    "cons4": "t th d dh n",
    "cons5": "p ph b bh m",
    "cons6": "sh Sh s h",
    "semi-vowel": "y r R l L zh v",
    "unaspirated": "k g ch j T D t p b",
    "aspirated": "kh gh Ch jh Th Dh th d dh ph bh",
    "nasal": "~N ~n N n Nn m",
}
_NORTHERN_LENGTHS = {"short": "a i u E i0 u0 e^0", "long": "A I U ai O au A0 I0 U0 E0 ai0 o^0 O0 au0"}
_SOUTHERN_LENGTHS = {"short": "a i u e o i0 u0 RRi0 e0 E0 o0", "long": "A I U E ai O au A0 I0 U0 RRI0 ai0 O0 au0"}
# Groups that a language has of its own, in place of those above; empty ones it has not.
OWN_GROUPS = {
    "hindi": _NORTHERN_LENGTHS,
    "marathi": _NORTHERN_LENGTHS,
    "nepali": _NORTHERN_LENGTHS | {"cons1": "k kh g gh", "cons2": "ch Ch j jh", "unaspirated": ""},
    "bengali": _NORTHERN_LENGTHS,
    "punjabi": _NORTHERN_LENGTHS,
    "gujarati": {"short": "a i u e^ E o^ i0 u0 RRi0 e^0 E0 o^0", "long": "A I U ai O au A0 I0 U0 RRI0 ai0 O0 au0"},
    "tamil": {"short": "a i u e o i0 u0 e0 o0", "long": "A I U E ai O au A0 I0 U0 E0 ai0 O0 au0", "cons1": "k", "unaspirated": "p", "aspirated": ""},
    "telugu": _SOUTHERN_LENGTHS,
    "kannada": _SOUTHERN_LENGTHS,
    "malayalam": _SOUTHERN_LENGTHS,
}
# Digits and their places in a block; Nepali types none.
DIGITS = {"nepali": "", "tamil": "1:67 2:68 3:69 4:6a 5:6b 6:6c 7:6d 8:6e 9:6f 10:70 100:71 1000:72"}
_DIGITS = "0:66 1:67 2:68 3:69 4:6a 5:6b 6:6c 7:6d 8:6e 9:6f"
#: Languages whose ng is no consonant to the patterns.
NG_APART = ("hindi", "nepali", "gujarati", "kannada")

# How consonants are typed: without the vowel, with and without it, with it.
BARE, EITHER, WITH_A = "bare", "either", "with a"
NORTHERN = [("{own}{nk}(?:{halanth}|{mathra}|$)", BARE), ("(?<!^){own}{nk}(?!{dot}|{cons}$)", EITHER), ("{own}{nk}", WITH_A)]
SOUTHERN = [("{own}{nk}(?:{halanth}|{mathra})", BARE), ("{own}{nk}", WITH_A)]
NEPALI = [("{own}{nk}(?:{halanth}|{mathra})", BARE), ("{own}{nk}(?:$)", EITHER), ("^{own}(?:{h})", "with e"), ("(?<!^){own}{nk}(?!{dot}|{cons}$)", EITHER), ("{own}{nk}", WITH_A)]
#: Nepali consonants without the form before an initial h.
NO_E = "kh gh ~N ~n N h"
STYLE = {"nepali": NEPALI, "tamil": SOUTHERN, "telugu": SOUTHERN, "kannada": SOUTHERN, "malayalam": SOUTHERN}

# Letters with rules of their own.
_CLUSTER_CH = "(?:(?:{ch}|{Ch}){nk}{halanth})"
_NORTHERN_OWN = {
    "k": [("{own}(?:{halanth}|{mathra}|$)", "k"), ("(?<!^){own}(?!{dot}|{cons}$)", "ka k"), ("{own}", "ka"), ("{own}{nukta}(?:{halanth}|{mathra}|$)", "k q"), ("(?<!^){own}{nukta}(?!{dot}|{cons}$)", "ka k qa q"), ("{own}{nukta}", "ka qa")],
    "ch": [*NORTHERN[:2], (_CLUSTER_CH + "{own}{nk}(?:{halanth}|{mathra}|$)", "ch h"), (_CLUSTER_CH + "{own}{nk}(?!{dot}|{cons}$)", "cha ha"), NORTHERN[2]],
    "Ch": [*NORTHERN[:2], (_CLUSTER_CH + "{own}{nk}(?:{halanth}|{mathra}|$)", "ch h"), (_CLUSTER_CH + "{own}{nk}(?!{dot}|{cons}$)", "cha ha"), NORTHERN[2]],
    "j": [("{own}(?:{halanth}|{mathra}|$)", "j"), ("(?<!^){own}(?!{dot}|{cons}$)", "ja j"), ("{own}{nk}(?:{halanth}{~n})", "j g"), ("{own}", "ja"), ("{own}{nukta}(?:{halanth}|{mathra}|$)", "j z"), ("(?<!^){own}{nukta}(?!{dot}|{cons}$)", "ja j za z"), ("{own}{nukta}", "ja za")],
    "~n": [NORTHERN[0], (NORTHERN[1][0], "nya na ny n"), NORTHERN[2]],
    "t": [NORTHERN[0], (NORTHERN[1][0], "t ta tha th"), NORTHERN[2]],
}
_SOUTHERN_OWN = {
    "ch": [SOUTHERN[0], (_CLUSTER_CH + "{own}{nk}(?:{halanth}|{mathra})", "ch h"), (_CLUSTER_CH + "{own}{nk}(?!{dot}|{cons}$)", "cha ha"), SOUTHERN[1]],
    "Ch": [SOUTHERN[0], (_CLUSTER_CH + "{own}{nk}(?:{halanth}|{mathra})", "ch h"), (_CLUSTER_CH + "{own}{nk}(?!{dot}|{cons}$)", "cha ha"), SOUTHERN[1]],
    "j": [("{own}(?:{halanth}|{mathra})", "j"), ("{own}{nk}(?:{halanth}{~n})", "j g"), ("{own}", "ja"), ("{own}{nukta}(?:{halanth}|{mathra})", "j z"), ("{own}{nukta}", "ja za")],
}
_GLIDES = {  # vowels at the start of a word
    "i": [("^{own}", "i yi"), ("{own}", "i")],
    "I": [("^{own}", "I i yi"), ("{own}", "I i")],
    "u": [("^{own}", "u vu"), ("{own}", "u")],
    "U": [("^{own}", "U"), ("{own}", "U u")],
}
_SOUTHERN_VOWELS = _GLIDES | {
    "e": [("^{own}", "e ye"), ("{own}", "e")],
    "E": [("^{own}", "e ye ey"), ("{own}", "e")],
    "O": [("{own}$", "o oh"), ("{own}", "o")],
    "ai0": [("(?<={cons}){own}(?={cons})", "ai y"), ("{own}", "ai")],
}
_AFTER_VOWEL = "(?:{mathra}|{vowel})"
_HINDI_VOWELS = {
    "i": [(_AFTER_VOWEL + "{own}", "i yi"), *_GLIDES["i"]],
    "I": [(_AFTER_VOWEL + "{own}", "I i yi yI"), *_GLIDES["I"]],
    "u": [(_AFTER_VOWEL + "{own}", "u vu"), *_GLIDES["u"]],
    "U": [(_AFTER_VOWEL + "{own}", "U u vu vU"), *_GLIDES["U"]],
    "E": [(_AFTER_VOWEL + "{own}", "e ye ey"), ("^{own}", "e ye"), ("{own}", "e")],
    "O": [(_AFTER_VOWEL + "{own}", "o vo"), ("{own}", "o")],
    "e^0": [("{own}", "a")],
    "E0": [("{own}(?:{anusvara}|{chandra-bindu})", "e ei"), ("{own}", "e")],
}
_NEPALI_BARE, _NEPALI_END, _NEPALI_H = NEPALI[0], NEPALI[1], NEPALI[2]
OWN = {
    "hindi": _NORTHERN_OWN | _HINDI_VOWELS,
    "marathi": _NORTHERN_OWN | _HINDI_VOWELS | {"jh": [(NORTHERN[0][0], "jh z"), (NORTHERN[1][0], "jha jh za z"), (NORTHERN[2][0], "jha zha")]},
    "bengali": _NORTHERN_OWN | _HINDI_VOWELS,
    "punjabi": _NORTHERN_OWN | _HINDI_VOWELS,
    "gujarati": _NORTHERN_OWN
    | _GLIDES
    | {
        "e^": [("^{own}", "e ye"), ("{own}", "e")],
        "E": [("(?:{mathra}|{vowel}){own}", "e ye ey"), ("^{own}", "e ye"), ("{own}", "e")],
        "O": [("{own}$", "o oh vo"), ("{own}", "o")],
        "ai0": [("(?<={cons}){own}(?={cons})", "ai y"), ("{own}", "ai")],
    },
    "nepali": _HINDI_VOWELS
    | {
        "k": [("{own}(?:{halanth}|{mathra})", "k"), ("{own}(?:$)", "ka k"), ("^{own}(?:{h})", "ka ke"), ("(?<!^){own}(?!{dot}|{cons}$)", "ka k"), ("{own}", "ka"), ("{own}{nukta}(?:{halanth}|{mathra})", "k q"), ("{own}{nukta}(?:$)", "ka k qa q"), ("^{own}{nukta}(?:{h})", "ka ke qa qe"), ("(?<!^){own}{nukta}(?!{dot}|{cons}$)", "ka k qa q"), ("{own}{nukta}", "ka qa")],
        "ch": [*NEPALI[:4], (_CLUSTER_CH + "{own}{nk}(?:{halanth}|{mathra}|$)", "ch"), (_CLUSTER_CH + "{own}{nk}(?!{dot}|{cons}$)", "cha"), NEPALI[4]],
        "Ch": [*NEPALI[:2], ("^{own}(?:{h})", "Cha Che"), NEPALI[3], (_CLUSTER_CH + "{own}{nk}(?:{halanth}|{mathra}|$)", "ch"), (_CLUSTER_CH + "{own}{nk}(?!{dot}|{cons}$)", "cha"), NEPALI[4]],
        "j": [("{own}(?:{halanth}|{mathra})", "j"), ("{own}(?:$)", "ja j"), ("^{own}(?:{h})", "ja je"), ("(?<!^){own}(?!{dot}|{cons}$)", "ja j"), ("{own}{nk}(?:{halanth}{~n})", "j g"), ("{own}", "ja"), ("{own}{nukta}(?:{halanth}|{mathra})", "j z"), ("{own}{nukta}(?:$)", "ja j za z"), ("^{own}{nukta}(?:{h})", "ja je za ze"), ("(?<!^){own}{nukta}(?!{dot}|{cons}$)", "ja j za z"), ("{own}{nukta}", "ja za")],
        "~n": [NEPALI[0], ("{own}{nk}(?:$)", "ny nya na nyn"), ("(?<!^){own}{nk}(?!{dot}|{cons}$)", "nya na ny n"), NEPALI[4]],
        "t": [NEPALI[0], ("{own}{nk}(?:$)", "ta t tha th"), ("^{own}(?:{h})", "ta te"), ("(?<!^){own}{nk}(?!{dot}|{cons}$)", "t ta tha th"), NEPALI[4]],
        "d": [*NEPALI[:4], ("{own}(?:{r})", "da de"), NEPALI[4]],
        "y": [("{own}{nk}(?:$)", "y i"), *NEPALI[:3], ("(?:{A0}){own}{nk}(?:{cons})", "ya i"), *NEPALI[3:]],
        "v": [*NEPALI[:4], ("(?:{r}{A0}){own}{nk}", "va v o"), ("(?:{d}{E0}){own}{nk}", "va v o"), NEPALI[4]],
        "I0": [("{own}(?:$)", "I i y"), ("{own}", "I i")],
        "E0": [("{own}(?:{anusvara}|{chandra-bindu})", "e ei"), ("{own}(?:$)", "e ey ay"), ("{own}", "e")],
        "O0": [("{own}(?:$)", "o oh"), ("{own}", "o")],
    },
    "kannada": _SOUTHERN_OWN | _SOUTHERN_VOWELS,
    "telugu": _SOUTHERN_OWN
    | _SOUTHERN_VOWELS
    | {
        "y": [SOUTHERN[0], ("(?:{A0}){own}{nk}(?:{u0})", "y i"), SOUTHERN[1]],
        "v": [SOUTHERN[0], ("(?:{r}{A0}){own}{nk}(?:{u0})", "v o"), SOUTHERN[1]],
        "sh": [(SOUTHERN[0][0], "s sh"), (SOUTHERN[1][0], "sa sha")],
        "I0": [("{own}", "I i"), ("{own}(?:$)", "I i y")],
        "u0": [("{own}", "u"), ("(?:{A0}{y}{nk}){own}", "u -"), ("(?:{r}{A0}{v}{nk}){own}", "u -")],
        "E0": [("{own}", "e"), ("{own}(?:$)", "e ey ay")],
    },
    "malayalam": _SOUTHERN_OWN
    | _SOUTHERN_VOWELS
    | {
        ".n": [("{own}$", "m"), ("{own}", "n m")],
        "k": [("{own}{nk}(?:{halanth}{k})", "k"), ("(?:{k}{halanth}){own}(?:{halanth}|{mathra})", "k"), ("(?:{k}{halanth}){own}", "ka ka"), ("(?<!^){own}{nk}(?:{halanth}{semi-vowel})", "k"), ("(?<!^){own}{nk}(?:{halanth}|{mathra})", "k g"), ("(?<!^){own}{nk}", "ka ga"), *SOUTHERN],
        "~N": [("{own}{nk}(?:{halanth}{~N})", "ng"), ("(?:{~N}{halanth}){own}{nk}(?:{halanth}|{mathra})", "-"), ("(?:{~N}{halanth}){own}{nk}", "a"), ("{own}{nk}(?:{halanth}(?:{k}|{g}))", "n"), ("{own}{nk}(?:{halanth}|{mathra})", "n ng"), ("{own}{nk}", "na nga")],
        "ch": [("(?<!^){own}{nk}(?:{mathra})", "ch j"), ("(?<!^){own}{nk}(?:{dot}|{cons})", "cha ja"), SOUTHERN[0], (_CLUSTER_CH + "{own}{nk}(?:{halanth}|{mathra})", "ch h -"), (_CLUSTER_CH + "{own}{nk}", "cha ha a"), SOUTHERN[1], ("(?:{~n}{halanth}){own}(?:{halanth}|{mathra})", "j ch"), ("(?:{~n}{halanth}){own}", "ja cha")],
        "Ch": [SOUTHERN[0], (_CLUSTER_CH + "{own}{nk}(?:{halanth}|{mathra})", "ch h -"), (_CLUSTER_CH + "{own}{nk}", "cha ha a"), SOUTHERN[1]],
        "~n": [("{own}{nk}(?:{halanth}{~n})", "nj ny"), ("(?:{~n}{halanth}){own}{nk}(?:{halanth}|{mathra})", "-"), ("(?:{~n}{halanth}){own}{nk}", "a"), ("{own}{nk}(?:{halanth})", "n"), ("{own}{nk}(?:{mathra})", "jn n ny"), ("{own}{nk}", "jna na nya")],
        "T": [("{own}{nk}(?:{halanth}{T})", "t"), ("(?:{T}{halanth}){own}(?:{halanth}|{mathra})", "t"), ("(?:{T}{halanth}){own}", "ta"), ("{own}{nk}(?:{halanth}|{mathra})", "t d"), ("{own}{nk}", "ta da")],
        "Dh": [SOUTHERN[0], ("(?:(?:{D}|{Dh}|{d}|{dh}){nk}{halanth}){own}{nk}(?:{halanth}|{mathra})", "d dh"), ("(?:(?:{D}|{Dh}|{d}|{dh}){nk}{halanth}){own}{nk}", "da dha"), SOUTHERN[1]],
        "t": [("{own}{nk}(?:{halanth}{t})", "t"), ("(?:{t}{halanth}){own}(?:{halanth}|{mathra})", "h t"), ("(?:{t}{halanth}){own}", "ha ta"), ("(?<!^){own}{nk}(?:{halanth}|{mathra})", "t th d"), ("(?<!^){own}{nk}", "ta tha da"), *SOUTHERN],
        "d": [SOUTHERN[0], ("(?:{d}{nk}{halanth}){own}{nk}(?:{halanth}|{mathra})", "d h"), ("(?:{d}{nk}{halanth}){own}{nk}", "da ha"), SOUTHERN[1]],
        "dh": [SOUTHERN[0], ("(?:(?:{D}|{Dh}|{d}|{dh}){nk}{halanth}){own}{nk}(?:{halanth}|{mathra})", "d dh"), ("(?:(?:{D}|{Dh}|{d}|{dh}){nk}{halanth}){own}{nk}", "da dha"), SOUTHERN[1]],
        "p": [("(?:{m}{halanth}|{anusvara}){own}(?:{halanth}|{mathra})", "p b"), ("(?:{m}{halanth}|{anusvara}){own}", "pa ba"), *SOUTHERN],
        "b": [("(?:{m}{halanth}|{anusvara}){own}(?:{halanth}|{mathra})", "b p"), ("(?:{m}{halanth}|{anusvara}){own}", "ba pa"), *SOUTHERN],
        "y": [("(?:{i}|{i0}){own}{nk}(?:{halanth}{cons})", "y -"), *SOUTHERN],
        "R": [
            ("(?:{halanth}){own}{nk}(?:{halanth}{R})", "t"), ("(?:{halanth}{R}{halanth}){own}{nk}(?:{halanth}|{mathra})", "-"), ("(?:{halanth}{R}{halanth}){own}{nk}", "a"), ("{own}{nk}(?:{halanth}{R})", "t"), ("(?:{R}{halanth}){own}{nk}(?:{halanth})", "t -"), ("(?:{R}{halanth}){own}{nk}(?:{mathra})", "t"),
            ("(?:{R}{halanth}){own}{nk}", "ta"), ("(?:{halanth}){own}{nk}(?:{halanth}|{mathra})", "t d"), ("(?:{halanth}){own}{nk}", "ta da"), ("{own}{nk}(?:{halanth}{cons})", "t"), *SOUTHERN,
        ],
        "zh": [(SOUTHERN[0][0], "zh l"), (SOUTHERN[1][0], "zha la")],
        "halanth": [("(?:{l}|{L}|{n}|{N}|{r}){own}(?:{zwj})$", "-"), ("{own}(?:{zwnj})?$", "u uh eh -"), ("{own}", "-")],
    },
    "tamil": _GLIDES
    | {
        "U": [("^{own}", "U u"), ("{own}", "U u")],
        "e": [("^{own}", "e ye"), ("{own}", "e")],
        "E": [("^{own}", "e ye"), ("{own}", "e")],
        "H": [("{own}(?:{p})", "-"), ("{own}", "g")],
        "k": [("{own}(?:{halanth}{k})", "k"), ("(?:{k}{halanth}){own}(?:{halanth}|{mathra})", "k -"), ("(?:{k}{halanth}){own}", "ka a"), ("{own}(?:{halanth}|{mathra})", "k g"), ("{own}", "ka ga")],
        "~N": [("{own}{nk}(?:{halanth}(?:{k}))", "n"), ("{own}(?:{halanth}|{mathra})", "n ng"), ("{own}", "na nga")],
        "ch": [("{own}(?:{halanth}{ch})", "ch"), ("(?:{ch}{halanth}){own}(?:{halanth}|{mathra})", "ch h -"), ("(?:{ch}{halanth}){own}", "cha ha a"), ("(?:{~n}{halanth}){own}(?:{halanth}|{mathra})", "j"), ("(?:{~n}{halanth}){own}", "ja"), ("{own}(?:{halanth}|{mathra})", "ch s"), ("{own}", "cha sa")],
        "~n": [("{own}{nk}(?:{mathra})", "n ny gn"), ("{own}{nk}(?:{halanth})", "n gn"), ("{own}{nk}", "na nya gna")],
        "T": [("{own}(?:{halanth}{T})", "t"), ("(?:{T}{halanth}){own}(?:{halanth}|{mathra})", "t -"), ("(?:{T}{halanth}){own}", "ta a"), ("{own}(?:{halanth}|{mathra})", "t d"), ("{own}", "ta da")],
        "N": [("{own}{nk}(?:{halanth}(?:{r}|{R}))", "n nd"), *SOUTHERN],
        "t": [("{own}(?:{halanth}{t})", "t"), ("(?:{t}{halanth}){own}(?:{halanth}|{mathra})", "t h -"), ("(?:{t}{halanth}){own}", "ta ha a"), ("{own}(?:{halanth}|{mathra})", "t th d"), ("{own}", "ta tha da")],
        "Nn": [("{own}{nk}(?:{halanth}(?:{r}|{R}))", "n nd"), *SOUTHERN],
        "p": [("(?:{H}){own}{nk}(?:{halanth}|{mathra})", "f"), ("(?:{H}){own}{nk}", "fa"), ("{own}(?:{halanth}{p})", "p"), ("(?:{p}{halanth}){own}(?:{halanth}|{mathra})", "p -"), ("(?:{p}{halanth}){own}", "pa a"), ("{own}(?:{halanth}|{mathra})", "p b"), ("{own}", "pa ba")],
        "y": [("(?:{vowel}|{mathra}){own}{nk}(?:{halanth})", "y i"), *SOUTHERN],
        "R": [("{own}{nk}(?:{halanth}{R})", "t"), *SOUTHERN],
        "zh": [(SOUTHERN[0][0], "l zh"), (SOUTHERN[1][0], "la zha")],
        "Sh": [("{own}{nk}(?:{halanth}|{mathra}|$)", "sh"), SOUTHERN[1]],
        "i0": [("(?:{cons}){own}(?:{y}|{r}|{l})(?!{halanth}$)", "i -"), ("{own}$", "i y"), ("{own}", "i")],
        "u0": [("(?:{cons}){own}(?:{v})", "u -"), ("{own}", "u")],
        "E0": [("{own}", "e ei")],
    },
}
# Other letters' typed forms; a hyphen types nothing.
PLAIN = {
    "a": "a", "A": "A a", "RRi": "ri ru", "LLi": "lru", "RRI": "roo", "ai": "ai", "au": "ou", "i": "i", "I": "I i", "u": "u", "U": "U u", "e^": "e", "e": "e", "E": "e", "o^": "o", "o": "o", "O": "o",
    "A0": "A a", "i0": "i", "I0": "I i", "u0": "u", "U0": "U u", "RRi0": "ri ru", "RRI0": "roo", "e^0": "e", "e0": "e", "E0": "e", "ai0": "ai", "o^0": "o", "o0": "o", "O0": "o", "au0": "ou", "LLi0": "lru",
    ".N": "n m", ".n": "n m", "H": "h", "nukta": "-", "halanth": "-", "zwj": "-", "zwnj": "-", "OM": "om",
}

# Ordered rewrites of typed words before prediction.
_SOFT_C = [(r"(c)(?=[eiy])", "s"), (r"(c)(?!h)", "k"), (r"(ia)", "iya")]
_LONG = [(r"(aa)", "A"), (r"(ee)", "I"), (r"(oo)", "U")]
_LAST = [(r"(w)", "v"), (r"(ph)", "f"), (r"(x)", "ksh")]
_COMMON = [*_SOFT_C, (r"(au)", "ou"), *_LONG, *_LAST]
REWRITES = {
    "hindi": [*_SOFT_C, (r"(au)", "ou"), (r"^(hum)$", "ham"), (r"^(hoon)$", "hoom"), (r"(cch)", "chch"), *_LONG, *_LAST, (r"(gyan)", "gnyan")],
    "marathi": [*_SOFT_C, (r"(au)", "ou"), (r"^(hum)$", "ham"), *_LONG, *_LAST],
    "nepali": [*_SOFT_C[:2], (r"(chh)", "chch"), (r"(aiah)$", "ayya"), _SOFT_C[2], (r"(au)", "ou"), (r"^(hum)$", "ham"), *_LONG, *_LAST],
    "bengali": _COMMON,
    "punjabi": _COMMON,
    "gujarati": _COMMON,
    "kannada": _COMMON,
    "malayalam": _COMMON,
    "telugu": [*_COMMON, (r"(aiah$)", "ayya"), (r"(^rao$)", "rAvu")],
    "tamil": [(r"(c)(?=[eiy])", "s"), (r"(c)(?=[^h]|$)", "k"), (r"(ia)", "iya"), *_LONG, (r"(au)", "ou"), (r"(w)", "v"), (r"(x)", "ksh"), (r"(kh|K)", "k"), (r"(gh|G)", "g"), (r"(Ch)", "ch"), (r"(j|z(?!h)|jh|J|Jh)", "j"), (r"(dh|D)", "d"), (r"(ph)", "f"), (r"(bh|B)", "b")],
}


@cache
def alphabet(lang: str) -> dict[str, str]:
    """Letter by name, in table order."""
    base, out = LANGUAGES[lang].base, {"zwnj": "\u200c", "zwj": "\u200d"}
    for name, place in (x.rsplit(":", 1) for x in f"{OTHERS} {VOWELS} {CONSONANTS} {SIGNS}".split()):
        code = chr(base + int(place, 16))
        if name not in LEFT_OUT[lang].split() and unicodedata.category(code) != "Cn":
            out[name] = code
    out |= {name: chr(base + int(place, 16)) for name, place in (x.split(":") for x in DIGITS.get(lang, _DIGITS).split())}
    return {name: code for name, code in out.items() if unicodedata.category(code) != "Cn"}


@cache
def properties(lang: str) -> dict[str, list[str]]:
    """Letters by property: classes first, then each letter's own name."""
    own = alphabet(lang)
    kind = {"vowel": VOWELS, "mathra": SIGNS, "cons": CONSONANTS}
    out = {k: [own[n] for n, _ in (x.rsplit(":", 1) for x in names.split()) if n in own and not (k == "cons" and n == "~N" and lang in NG_APART)] for k, names in kind.items()}
    out |= {k: [own[n] for n in names.split() if n in own] for k, names in (GROUPS | OWN_GROUPS[lang]).items()}
    digits = [x.split(":")[0] for x in DIGITS.get(lang, _DIGITS).split()]
    out |= {"anusvara": [own[".n"]], "visarga": [own["H"]], "chandra-bindu": [own[".N"]] if ".N" in own else [], "digit": [own[n] for n in digits]}
    # marks that a bare consonant can't be dropped before; Tamil's are not counted as such
    out["dot"] = [] if lang == "tamil" else [own[n] for n in (".N", ".n", "H") if n in own]
    return {k: v for k, v in out.items() if v} | {name: [code] for name, code in own.items()}


def _filled(pattern: str, lang: str, own: str) -> str:
    known = properties(lang)

    def one(m: re.Match) -> str:
        if m[1] == "own":
            return f"({re.escape(own)})"
        if m[1] == "nk":
            return one(re.match(r"\{(nukta)\}", "{nukta}")) + "?"
        return f"[{''.join(known[m[1]])}]" if m[1] in known else "(?:)"

    return re.sub(r"\{([^{}0-9][^{}]*)\}", one, pattern)


@cache
def rules(lang: str) -> dict[str, list[tuple[str, tuple[str, ...]]]]:
    """(pattern with names in braces, typed forms) by native letter, in order."""
    own, special, style = alphabet(lang), OWN[lang], STYLE.get(lang, NORTHERN)
    consonants, out = {x.rsplit(":", 1)[0] for x in CONSONANTS.split()}, {}
    for name, code in own.items():
        bare = TYPED.get(name, [name.lower()])
        forms = {BARE: bare, WITH_A: [b + "a" for b in bare], EITHER: [b + "a" for b in bare] + bare, "with e": [bare[0] + "a", bare[0] + "e"]}
        if name in special:
            found = special[name]
        elif name in consonants:
            found = [r for r in style if not (r[1] == "with e" and name in NO_E.split())]
        else:
            found = [("{own}", PLAIN.get(name, name))]
        made = []
        for pattern, options in found:
            values = forms[options] if options in forms else [o.replace("-", "") for o in options.split()]
            made.append((pattern, tuple(values)))
        out[code] = made
    return out


@cache
def producers(lang: str) -> dict[str, list[tuple[str, tuple[str, ...]]]]:
    """(pattern, typed forms) by native letter, in order; names are filled in."""
    return {code: [(_filled(pattern, lang, code), options) for pattern, options in found] for code, found in rules(lang).items()}


@cache
def feature_groups(lang: str) -> list[tuple[str, list[str]]]:
    """Property by property, the different typed forms of its letters: the groups that trees ask for."""
    typed = {code: list(dict.fromkeys(o for _, options in found for o in options)) for code, found in producers(lang).items()}
    return [(f"is {p}", list(dict.fromkeys(o for code in letters for o in typed[code]))) for p, letters in properties(lang).items()]


def word_pattern(lang: str, plain: bool = False) -> str:
    """A valid word's letters; ``plain`` leaves out digits, whose neighbours need looking ahead."""
    marks = "(?:{anusvara}|{visarga}" + ("" if lang in ("tamil", "malayalam") else "|{chandra-bindu}") + ")?"
    joiner = "(?:{zwj}|{zwnj})?"
    close = {"nepali": "{halanth}" + joiner + "$", "telugu": "{halanth}" + joiner + "$", "malayalam": "{halanth}" + joiner}.get(lang, "{halanth}")
    digits = "" if plain or lang == "nepali" else "|{digit}(?![0-9])|[0-9](?!{digit})"
    return _filled("(?:{cons}{nk}(?:{halanth}" + joiner + "{cons}{nk})*(?:" + close + "|(?:{mathra}?" + marks + "))?|(?:{vowel}" + marks + ")" + digits + ")+", lang, "")
