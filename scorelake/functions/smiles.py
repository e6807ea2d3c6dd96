"""Validity of SMILES strings, whole or unfinished, without a chemistry library.

Checked: the grammar of atoms, bonds, branches and ring closures; ring bonds that close and agree; usual valences of atoms
written without brackets; aromatic systems that can be given alternating double bonds. Drug-likeness needs a chemistry
library; ``molecule_scores`` takes a scorer for it and gives 1 or 0 for validity without one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.functions.texts import trimmed, weight

# Most bonds of atoms of the organic subset, and orders of bond symbols.
VALENCE = {"B": 3, "C": 4, "N": 5, "O": 2, "P": 5, "S": 6, "F": 1, "Cl": 1, "Br": 1, "I": 1, "b": 3, "c": 4, "n": 5, "o": 2, "p": 5, "s": 6}
ORDER = {"-": 1, "=": 2, "#": 3, "$": 4, ":": 1, "/": 1, "\\": 1}

_BRACKET = re.compile(
    r"\[(?P<isotope>[1-9]\d{0,2})?(?P<symbol>se|as|[bcnops]|[A-Z][a-z]?|\*)(?P<chiral>@(?:@|TH[12]|AL[12]|SP[1-3]|TB[1-9]\d?|OH[1-9]\d?)?)?(?P<h>H\d?)?(?P<charge>\+(?:\+|\d{1,2})?|-(?:-|\d{1,2})?)?(?::\d+)?\]"
)
#: What an unfinished bracket may hold.
_OPEN_BRACKET = re.compile(r"\[(?:[1-9]\d{0,2})?(?:(?:se?|as?|[bcnops]|[A-Z][a-z]?|\*)(?:@(?:@|T(?:H[12]?|B(?:[1-9]\d?)?)?|A(?:L[12]?)?|S(?:P[1-3]?)?|O(?:H(?:[1-9]\d?)?)?)?)?(?:H\d?)?(?:\+(?:\+|\d{1,2})?|-(?:-|\d{1,2})?)?(?::\d*)?)?$")
_ORGANIC = re.compile(r"Br|Cl|[BCNOPSFI]|[bcnops]|\*")
_RING = re.compile(r"%[1-9]\d|\d")
_ELEMENTS = set(
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe "
    "Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og".split()
)


class Molecule:
    """Atoms and bonds read so far."""

    def __init__(self) -> None:
        self.symbol: list[str] = []
        self.bracket: list[bool] = []
        self.hydrogens: list[int] = []
        self.charge: list[int] = []
        self.bonds: list[dict[int, int]] = []  # neighbour -> order, 0 for one left to the atoms

    def atom(self, symbol: str, bracket: bool, hydrogens: int = 0, charge: int = 0) -> int:
        self.symbol.append(symbol)
        self.bracket.append(bracket)
        self.hydrogens.append(hydrogens)
        self.charge.append(charge)
        self.bonds.append({})
        return len(self.symbol) - 1

    def bond(self, a: int, b: int, order: int) -> bool:
        if a == b or b in self.bonds[a]:
            return False
        self.bonds[a][b] = self.bonds[b][a] = order
        return True

    def used(self, a: int) -> int:
        return sum(o or 1 for o in self.bonds[a].values())

    def too_many(self, a: int, more: int = 0) -> bool:
        most = VALENCE.get(self.symbol[a])
        return most is not None and not self.bracket[a] and self.used(a) + more > most

    def aromatic(self, a: int) -> bool:
        return self.symbol[a][0].islower()

    def needs_double(self, a: int) -> bool:
        """An aromatic atom that must have a double bond within its system."""
        s, bonds = self.symbol[a], self.bonds[a]
        if any(o and o > 1 for o in bonds.values()):
            return False
        n = len(bonds) + self.hydrogens[a]
        if s == "c":
            return self.charge[a] == 0 or n == 3 and self.charge[a] > 0
        if s in ("n", "p", "as"):
            return n == 2 and self.charge[a] == 0 or n == 3 and self.charge[a] == 1
        if s in ("o", "s", "se"):
            return self.charge[a] == 1
        return False

    def kekule(self) -> bool:
        """True if all aromatic atoms that need a double bond can be paired along bonds (augmenting paths with blossoms
        left to search by trial: aromatic systems are small)."""
        need = [a for a in range(len(self.symbol)) if self.aromatic(a) and self.needs_double(a)]
        member = set(need)
        near = {a: [b for b, o in self.bonds[a].items() if b in member and o in (0, 1)] for a in need}
        mate: dict[int, int] = {}
        steps = 0

        def match() -> bool:
            nonlocal steps
            steps += 1
            if steps > 20_000:
                return True  # undecided: not a definite error
            free = [a for a in need if a not in mate]
            if not free:
                return True
            a = min(free, key=lambda x: sum(b not in mate for b in near[x]))
            for b in near[a]:
                if b not in mate:
                    mate[a], mate[b] = b, a
                    if match():
                        return True
                    del mate[a], mate[b]
            return False

        return match()


def is_valid(text: str, partial: bool = False) -> bool:
    """True if text is a SMILES string or, with ``partial``, may be the beginning of one."""
    m = Molecule()
    at, last, bond, stack = 0, None, None, []
    rings: dict[str, tuple[int, int | None]] = {}
    while at < len(text):
        ch = text[at]
        if ch == "(":
            if last is None or bond is not None:
                return False
            stack.append(last)
            at += 1
            if at < len(text) and text[at] in "()":
                return False
        elif ch == ")":
            if not stack or bond is not None or last is None:
                return False
            last = stack.pop()
            at += 1
        elif ch == "." or ch in ORDER:
            if last is None or bond is not None:
                return False
            bond = 0 if ch == "." else ORDER[ch]
            bond = ("none",) if ch == "." else bond
            at += 1
        elif ring := _RING.match(text, at):
            if last is None or bond == ("none",):
                return False
            number = ring.group().lstrip("%")
            at = ring.end()
            if number in rings:
                other, order = rings.pop(number)
                if order is not None and bond is not None and order != bond:
                    return False
                joined = bond if bond is not None else order
                if not m.bond(last, other, joined or 0) or m.too_many(last) or m.too_many(other):
                    return False
            else:
                rings[number] = (last, bond)
                pending = sum((o or 1) for a, o in rings.values() if a == last)
                if m.too_many(last, pending):
                    return False
            bond = None
        elif ch == "%":
            return partial and last is not None and re.fullmatch(r"%[1-9]?", text[at:]) is not None
        else:
            if ch == "[":
                hit = _BRACKET.match(text, at)
                if not hit:
                    return partial and _OPEN_BRACKET.match(text[at:]) is not None
                symbol = hit["symbol"]
                if symbol[0].isupper() and symbol not in _ELEMENTS:
                    return False
                charge = hit["charge"] or ""
                value = int(charge[1:]) if charge[1:].isdigit() else len(charge)
                if value > 15:
                    return False
                h = hit["h"] or ""
                new = m.atom(symbol, True, int(h[1:] or 1) if h else 0, value if charge[:1] == "+" else -value)
            else:
                hit = _ORGANIC.match(text, at)
                if not hit:
                    return False
                new = m.atom(hit.group(), False)
            at = hit.end()
            if last is not None and bond != ("none",):
                if not m.bond(last, new, bond or 0):
                    return False
                pending = sum((o or 1) for a, o in rings.values() if a == last)
                if m.too_many(last, pending) or m.too_many(new):
                    # B and C may be begun as Br and Cl: an unfinished last letter is no definite error
                    if not (partial and at == len(text) and hit.group() in ("B", "C") and not m.too_many(last, pending)):
                        return False
            last, bond = new, None
    if partial:
        return True
    return last is not None and bond is None and not stack and not rings and m.kekule()


@F.pandas_udf(T.BooleanType())
def _whole(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in parts:
        yield pd.Series([None if t is None else is_valid(t) for t in texts], dtype=object)


@F.pandas_udf(T.BooleanType())
def _begun(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in parts:
        yield pd.Series([None if t is None else is_valid(t, partial=True) for t in texts], dtype=object)


def smiles_valid(text: Column) -> Column:
    return _whole(text)


def complete_weight(text: Column) -> Column:
    """0 for a whole SMILES string after one leading space at most, else minus infinity; the empty string is none."""
    return weight(_whole(F.regexp_replace(text, "^ ", "")))


def prefix_weight(text: Column) -> Column:
    """0 if text, after one leading space at most, may begin a SMILES string, else minus infinity; the empty string may."""
    return weight(_begun(F.regexp_replace(text, "^ ", "")))


def quantitative_estimate(smiles: str) -> float:
    """Drug-likeness by the optional chemistry library; raises ImportError without it."""
    from rdkit import Chem
    from rdkit.Chem import QED

    molecule = Chem.MolFromSmiles(smiles)
    if molecule is None:
        return 0.0
    Chem.Kekulize(molecule)
    return float(QED.qed(molecule))


def molecule_scores(df: DataFrame, response: str, scorer: Callable[[str], float] | None = None) -> DataFrame:
    """df with score and desc (valid, invalid) of the trimmed response; ``scorer`` gives a valid molecule's score.

    Without a scorer a valid molecule scores 1: validity, not drug-likeness. Each distinct molecule is scored once.
    Null responses are invalid.
    """
    key = trimmed(F.col(response))

    @F.pandas_udf(T.DoubleType())
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([-1.0 if t is None or not is_valid(t) else 1.0 if scorer is None else float(scorer(t)) for t in texts])

    distinct = df.select(key.alias("_m")).where("_m is not null").distinct().withColumn("_s", scored("_m"))
    joined = df.withColumn("_k", key).join(distinct, F.col("_k") == F.col("_m"), "left")
    valid = F.coalesce(F.col("_s") >= 0, F.lit(False))
    return joined.withColumn("score", F.when(valid, F.col("_s")).otherwise(0.0)).withColumn("desc", F.when(valid, "valid").otherwise("invalid")).drop("_k", "_m", "_s")
