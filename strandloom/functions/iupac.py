"""Nucleotide codes, complements and genetic codes, in plain Python."""

from __future__ import annotations

import itertools
import re

#: IUPAC nucleotide codes (fixed values).
CODES = {"A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}

_PAIRS = "ATTAUACGGCRYYRKMMKBVVBDHHDSSWWNN"
DNA_FROM = _PAIRS[::2] + _PAIRS[::2].lower()
DNA_TO = _PAIRS[1::2] + _PAIRS[1::2].lower()
#: For RNA, A pairs with U.
RNA_FROM = DNA_FROM.replace("T", "").replace("t", "")
RNA_TO = "".join({"A": "U", "a": "u"}.get(c, DNA_TO[DNA_FROM.index(c)]) for c in RNA_FROM)


def complement(seq: str, rna: bool = False) -> str:
    return seq.translate(str.maketrans(RNA_FROM, RNA_TO) if rna else str.maketrans(DNA_FROM, DNA_TO))


def revcomp(seq: str) -> str:
    return complement(seq)[::-1]


def degenerate_regex(motif: str) -> str:
    """A regular expression for an IUPAC motif; case follows the motif's letters."""
    out = []
    for c in motif:
        letters = CODES.get(c.upper())
        if letters is None:
            out.append(re.escape(c))
            continue
        letters = letters + ("U" if c.upper() == "U" else "")
        letters = letters if c.isupper() else letters.lower()
        out.append(letters if len(letters) == 1 else f"[{letters}]")
    return "".join(out)


# -- genetic codes ------------------------------------------------------------------

#: The standard code for codons in TCAG order (fixed values), and its initiation codons.
STANDARD = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = ["".join(x) for x in itertools.product("TCAG", repeat=3)]
#: What each public genetic code changes in the standard one (fixed values).
CHANGES: dict[int, dict[str, str]] = {
    1: {},
    2: {"AGA": "*", "AGG": "*", "ATA": "M", "TGA": "W"},
    3: {"ATA": "M", "CTT": "T", "CTC": "T", "CTA": "T", "CTG": "T", "TGA": "W"},
    4: {"TGA": "W"},
    5: {"AGA": "S", "AGG": "S", "ATA": "M", "TGA": "W"},
    6: {"TAA": "Q", "TAG": "Q"},
    9: {"AAA": "N", "AGA": "S", "AGG": "S", "TGA": "W"},
    10: {"TGA": "C"},
    11: {},
    12: {"CTG": "S"},
    13: {"AGA": "G", "AGG": "G", "ATA": "M", "TGA": "W"},
    14: {"AAA": "N", "AGA": "S", "AGG": "S", "TAA": "Y", "TGA": "W"},
    16: {"TAG": "L"},
    21: {"TGA": "W", "ATA": "M", "AGA": "S", "AGG": "S", "AAA": "N"},
    22: {"TCA": "*", "TAG": "L"},
    23: {"TTA": "*"},
    24: {"AGA": "S", "AGG": "K", "TGA": "W"},
    25: {"TGA": "G"},
    26: {"CTG": "A"},
    27: {"TAA": "Q", "TAG": "Q", "TGA": "W"},
    28: {"TAA": "Q", "TAG": "Q", "TGA": "W"},
    29: {"TAA": "Y", "TAG": "Y"},
    30: {"TAA": "E", "TAG": "E"},
    31: {"TAA": "E", "TAG": "E", "TGA": "W"},
}
#: Initiation codons (fixed values).
STARTS = {
    1: "TTG CTG ATG", 2: "ATT ATC ATA ATG GTG", 3: "ATA ATG GTG", 4: "TTA TTG CTG ATT ATC ATA ATG GTG", 5: "TTG ATT ATC ATA ATG GTG", 6: "ATG", 9: "ATG GTG", 10: "ATG", 11: "TTG CTG ATT ATC ATA ATG GTG", 12: "CTG ATG", 13: "TTG ATA ATG GTG", 14: "ATG",
    16: "ATG", 21: "ATG GTG", 22: "ATG", 23: "ATT ATG GTG", 24: "TTG CTG ATG GTG", 25: "TTG ATG GTG", 26: "CTG ATG", 27: "ATG", 28: "ATG", 29: "ATG", 30: "ATG", 31: "ATG",
}


def genetic_code(number: int) -> dict[str, str]:
    if number not in CHANGES:
        raise ValueError(f"no genetic code {number}")
    return dict(zip(CODONS, STANDARD, strict=True)) | CHANGES[number]


def ambiguous_code(number: int) -> dict[str, str]:
    """The code with every IUPAC codon whose expansions all agree."""
    plain = genetic_code(number)
    letters = [c for c in CODES if c != "U"]
    out = {}
    for codon in itertools.product(letters, repeat=3):
        amino = {plain["".join(x)] for x in itertools.product(*(CODES[c] for c in codon))}
        if len(amino) == 1:
            out["".join(codon)] = amino.pop()
    return out
