"""Sequential Porter stemmer used only as a test oracle (brute force, per word).

Written from the published algorithm description (classic Porter with the
``bli -> ble`` and ``logi -> log`` departures of the reference C version).
"""


def _cons(w, i):
    c = w[i]
    if c in "aeiou":
        return False
    if c == "y":
        return True if i == 0 else not _cons(w, i - 1)
    return True


def _m(w, n):
    """Measure of w[:n]."""
    m, i = 0, 0
    while i < n and _cons(w, i):
        i += 1
    while i < n:
        while i < n and not _cons(w, i):
            i += 1
        if i >= n:
            break
        m += 1
        while i < n and _cons(w, i):
            i += 1
    return m


def _vowel_in(w, n):
    return any(not _cons(w, i) for i in range(n))


def _doublec(w):
    return len(w) >= 2 and w[-1] == w[-2] and _cons(w, len(w) - 1)


def _cvc(w, i):
    if i < 2 or not _cons(w, i) or _cons(w, i - 1) or not _cons(w, i - 2):
        return False
    return w[i] not in "wxy"


STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
         ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"),
         ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
         ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""),
         ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism",
         "ate", "iti", "ous", "ive", "ize"]


def stem(w: str) -> str:
    if len(w) <= 2:
        return w
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-3] + "i"
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    # 1b
    if w.endswith("eed"):
        if _m(w, len(w) - 3) > 0:
            w = w[:-1]
    else:
        stem_ = None
        if w.endswith("ed"):
            if _vowel_in(w, len(w) - 2):
                stem_ = w[:-2]
        elif w.endswith("ing"):
            if _vowel_in(w, len(w) - 3):
                stem_ = w[:-3]
        if stem_ is not None:
            w = stem_
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _doublec(w):
                if w[-1] not in "lsz":
                    w = w[:-1]
            elif _m(w, len(w)) == 1 and _cvc(w, len(w) - 1):
                w += "e"
    # 1c
    if w.endswith("y") and _vowel_in(w, len(w) - 1):
        w = w[:-1] + "i"
    # 2, 3
    for rules in (STEP2, STEP3):
        for suf, rep in rules:
            if w.endswith(suf):
                if _m(w, len(w) - len(suf)) > 0:
                    w = w[:-len(suf)] + rep
                break
    # 4
    for suf in STEP4:
        if w.endswith(suf):
            n = len(w) - len(suf)
            ok = True
            if suf == "ion":
                ok = n >= 1 and w[n - 1] in "st"
            if ok and _m(w, n) > 1:
                w = w[:n]
            break
    # 5
    if w.endswith("e"):
        a = _m(w, len(w))
        if a > 1 or (a == 1 and not _cvc(w, len(w) - 2)):
            w = w[:-1]
    if w.endswith("l") and _doublec(w) and _m(w, len(w)) > 1:
        w = w[:-1]
    return w
