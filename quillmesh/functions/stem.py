"""English stems after the published Snowball English (Porter2) description, as a pandas function (T-13).

Written from the algorithm's public description; no claim beyond the words that the tests name.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_V = "aeiouy"
# Fixed values of the algorithm.
_WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
_STAY = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
_STEP2 = {"ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble"}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic"]


def _region(w: str, start: int = 0) -> int:
    m = re.compile(f"[{_V}][^{_V}]").search(w, start)
    return m.end() if m else len(w)


def _short_end(w: str) -> bool:
    return bool(re.search(f"[^{_V}][{_V}][^{_V}wxY]$", w)) or bool(re.fullmatch(f"[{_V}][^{_V}]", w))


def stem(word: str) -> str:
    w = word.lower().replace("’", "'")
    if len(w) <= 2:
        return w
    w = w.lstrip("'")
    if w in _WHOLE:
        return _WHOLE[w]
    w = re.sub(f"(^|(?<=[{_V}]))y", "Y", w)
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = _region(w) if r1 is None else r1
    r2 = _region(w, r1)
    w = re.sub("'s'$|'s$|'$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif re.search("(ied|ies)$", w):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not re.search("(us|ss)$", w) and re.search(f"[{_V}].+s$", w):
        w = w[:-1]
    if w in _STAY:
        return w
    m = re.search("(eedly|eed)$", w)
    if m:
        if m.start() >= r1:
            w = w[: m.start()] + "ee"
    else:
        m = re.search("(ingly|edly|ing|ed)$", w)
        if m and re.search(f"[{_V}]", w[: m.start()]):
            w = w[: m.start()]
            if re.search("(at|bl|iz)$", w):
                w += "e"
            elif re.search("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
                w = w[:-1]
            elif r1 >= len(w) and _short_end(w):
                w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    for end, new in _STEP2.items():
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + new
            break
    else:
        if w.endswith("logi") and len(w) - 3 >= r1:
            w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in set("cdeghkmnrt"):
            w = w[:-2]
    for end, new in _STEP3.items():
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + new
            break
    else:
        if w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]
    for end in _STEP4:
        if w.endswith(end):
            if len(w) - len(end) >= r2:
                w = w[: -len(end)]
            break
    else:
        if w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
            w = w[:-3]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def lexemes(text: Column, stop: list[str]) -> Column:
    """Distinct stems of a text's words that aren't stop words."""
    known: dict[str, str] = {}

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            words = [w for w in re.findall(r"[a-z0-9]+(?:['’][a-z]+)?", (t or "").lower()) if w not in stop]
            out.append(sorted({known.get(w) or known.setdefault(w, stem(w)) for w in words}))
        return pd.Series(out, dtype=object)

    return run(text)
