"""Pedigree graphs: validation, generations, kinship and expected relations. A pedigree is small, so it is read whole, up to a stated size."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame

from .family import on_pedigree

#: People that a pedigree may have to be worked on in the driver.
MOST_PEOPLE = 100_000


class Pedigree:
    def __init__(self, rows: list[tuple[str, str | None, str | None, str | None]]):
        """rows: (person, father, mother, sex); '0' or None: founder."""
        if len(rows) > MOST_PEOPLE:
            raise ValueError(f"a pedigree of more than {MOST_PEOPLE} people")
        known = lambda x: None if x in (None, "0", "") else x
        self.parents = {p: (known(f), known(m)) for p, f, m, _ in rows}
        self.sex = {p: s for p, _, _, s in rows}
        self.people = sorted({*self.parents, *(x for pair in self.parents.values() for x in pair if x)})
        self.depth = self._generations()

    @classmethod
    def of(cls, df: DataFrame) -> Pedigree:
        rows = df.select("sample_id", "father_id", "mother_id", "sex").limit(MOST_PEOPLE + 1).collect()
        return cls([tuple(r) for r in rows])

    def _generations(self) -> dict[str, int]:
        """Generation of each person, founders 0; a loop is an error."""
        waiting = {p: [x for x in self.parents.get(p, (None, None)) if x] for p in self.people}
        depth: dict[str, int] = {}
        ready = [p for p, ps in waiting.items() if not ps]
        children: dict[str, list[str]] = {}
        for p, ps in waiting.items():
            for x in ps:
                children.setdefault(x, []).append(p)
        missing = {p: len(ps) for p, ps in waiting.items()}
        while ready:
            p = ready.pop()
            depth[p] = 1 + max((depth[x] for x in waiting[p]), default=-1)
            for c in children.get(p, ()):
                missing[c] -= 1
                if not missing[c]:
                    ready.append(c)
        if len(depth) < len(self.people):
            raise ValueError(f"people who descend from themselves: {', '.join(sorted(set(self.people) - set(depth)))}")
        return depth

    def problems(self) -> list[str]:
        """Parents of the wrong sex and people who are both parents of a child."""
        out = []
        for p, (f, m) in sorted(self.parents.items()):
            if f and f == m:
                out.append(f"{p}: {f} is both parents")
            if f and self.sex.get(f) == "female":
                out.append(f"{p}: father {f} is female")
            if m and self.sex.get(m) == "male":
                out.append(f"{p}: mother {m} is male")
        return out

    def trios(self) -> list[tuple[str, str, str]]:
        return [(p, f, m) for p, (f, m) in sorted(self.parents.items()) if f and m]

    def duos(self) -> list[tuple[str, str]]:
        return [(p, f or m) for p, (f, m) in sorted(self.parents.items()) if bool(f) != bool(m)]

    def kinship(self, a: str, b: str) -> float:
        """The chance that alleles drawn from both are the same by descent."""

        @lru_cache(None)
        def phi(x: str, y: str) -> float:
            if x == y:
                f, m = self.parents.get(x, (None, None))
                return 0.5 * (1 + (phi(*sorted((f, m))) if f and m else 0.0))
            if self.depth[x] < self.depth[y]:
                x, y = y, x
            return 0.5 * sum(phi(*sorted((p, y))) for p in self.parents.get(x, (None, None)) if p)

        return phi(*sorted((a, b)))

    def inbreeding(self, p: str) -> float:
        f, m = self.parents.get(p, (None, None))
        return self.kinship(f, m) if f and m else 0.0

    def expected(self, a: str, b: str) -> str:
        """The relation that the pedigree declares."""
        pa, pb = self.parents.get(a, (None, None)), self.parents.get(b, (None, None))
        if a == b:
            return "self"
        if a in pb or b in pa:
            return "parent-child"
        shared = {x for x in pa if x} & {x for x in pb if x}
        if len(shared) == 2:
            return "full-siblings"
        if len(shared) == 1:
            return "half-siblings"
        grand = lambda p: {g for x in self.parents.get(p, (None, None)) if x for g in self.parents.get(x, (None, None)) if g}
        if a in grand(b) or b in grand(a):
            return "grandparent"
        k = self.kinship(a, b)
        return "unrelated" if k == 0 else "second-degree" if k >= 0.125 else "third-degree" if k >= 0.0625 else "distant"


__all__ = ["MOST_PEOPLE", "Pedigree", "on_pedigree"]
