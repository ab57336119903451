"""Metaphone and weighted edit distance, one value at a time, to hold the operators against."""

_V = set("AEIOU")
_FRONT = set("EIY")


def metaphone(word: str) -> str:
    """Metaphone code of a whole string; what is no letter is passed over."""
    w = "".join(c for c in word.upper() if "A" <= c <= "Z")
    n, out, i = len(w), [], 0
    at = lambda k: w[k] if 0 <= k < n else ""
    if w[:2] in ("AE", "GN", "KN", "PN", "WR"):
        i = 1
        if w[:2] == "AE":
            out.append("E")
            i = 2
    elif w[:1] == "X":
        out.append("S")
        i = 1
    elif w[:2] == "WH":
        out.append("W")
        i = 2
    start = i
    while i < n:
        c, nx = w[i], at(i + 1)
        if c == at(i - 1) and c != "C" and i > start:
            i += 1
            continue
        skip = 0
        if c in _V:
            if i == start and not out:
                out.append(c)
        elif c == "B":
            if not (at(i - 1) == "M" and i == n - 1):
                out.append("B")
        elif c == "C":
            if nx and nx in _FRONT:
                if nx == "I" and at(i + 2) == "A":
                    out.append("X")
                elif at(i - 1) != "S":
                    out.append("S")
            elif nx == "H":
                out.append("K" if at(i + 2) == "R" or at(i - 1) == "S" else "X")
                skip = 1
            else:
                out.append("K")
        elif c == "D":
            if nx == "G" and at(i + 2) and at(i + 2) in _FRONT:
                out.append("J")
                skip = 1
            else:
                out.append("T")
        elif c == "G":
            if nx == "H":
                if not (at(i - 3) in ("B", "D", "H") or at(i - 4) == "H"):
                    out.append("F")
                    skip = 1
            elif nx == "N":
                if not (i + 2 >= n or at(i + 2) == "E" and at(i + 3) == "D" and i + 4 >= n):
                    out.append("K")
            elif nx and nx in _FRONT and at(i - 1) != "G":
                out.append("J")
            else:
                out.append("K")
        elif c == "H":
            if nx in _V and at(i - 1) not in ("C", "G", "P", "S", "T"):
                out.append("H")
        elif c == "K":
            if at(i - 1) != "C":
                out.append("K")
        elif c == "P":
            out.append("F" if nx == "H" else "P")
            skip = nx == "H"
        elif c == "Q":
            out.append("K")
        elif c == "S":
            if nx == "I" and at(i + 2) in ("O", "A"):
                out.append("X")
            elif nx == "H":
                out.append("X")
                skip = 1
            elif nx == "C" and at(i + 2) == "H" and at(i + 3) == "W":
                out.append("X")
                skip = 2
            else:
                out.append("S")
        elif c == "T":
            if nx == "I" and at(i + 2) in ("O", "A"):
                out.append("X")
            elif nx == "H":
                out.append("0")
                skip = 1
            elif not (nx == "C" and at(i + 2) == "H"):
                out.append("T")
        elif c == "V":
            out.append("F")
        elif c in "WY":
            if nx in _V and nx:
                out.append(c)
        elif c == "X":
            out.append("KS")
        elif c == "Z":
            out.append("S")
        else:  # F, J, L, M, N, R
            out.append(c)
        i += 1 + int(skip)
    return "".join(out)


def weighted_distance(a: str, b: str, insert: int = 1, replace: int = 1, delete: int = 1) -> int:
    """Edit distance of lower-case UTF-8 bytes with costs for turning a into b."""
    x, y = a.lower().encode(), b.lower().encode()
    row = [j * insert for j in range(len(y) + 1)]
    for i, c in enumerate(x, 1):
        new = [i * delete]
        for j, d in enumerate(y, 1):
            new.append(min(row[j - 1] + (0 if c == d else replace), row[j] + delete, new[-1] + insert))
        row = new
    return row[-1]
