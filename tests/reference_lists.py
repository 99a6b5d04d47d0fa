"""Packed lists and trace lines read by a plain character loop, to hold the column expressions against."""

import math

PAIRS = dict(zip("[({<", "])}>"))
QUOTES = {'"': '"', "'": "'", "`": "`"}
SEPARATORS = ",;|/:\\"


def read_list(text, kind):
    """Values, or None for a faulty list; kind is event or number."""
    if text is None:
        return None
    t = text.strip()
    if t and t[0] in PAIRS and len(t) > 1 and t[-1] == PAIRS[t[0]]:
        t = t[1:-1].strip()
    elif t and (t[0] in PAIRS or t[-1] in PAIRS.values()):
        return None
    if not t:
        return []
    parts, now, i, between = [], "", 0, False
    tokens = []  # ("v", text, quoted) or ("s",)
    while i < len(t):
        ch = t[i]
        if ch in QUOTES:
            run = ch
            while i + len(run) < len(t) and t[i + len(run)] == ch:
                run += ch
            end = t.find(run, i + len(run))
            if end < 0:
                return None
            tokens.append(("v", t[i + len(run) : end], True))
            i = end + len(run)
        elif t.startswith("->", i):
            tokens.append(("s",))
            i += 2
        elif ch in SEPARATORS:
            tokens.append(("s",))
            i += 1
        elif ch.isspace():
            tokens.append(("b",))
            i += 1
        else:
            j = i
            while j < len(t) and t[j] not in QUOTES and not t[j].isspace() and not t.startswith("->", j):
                inside_id = t[j] in "/:\\" and t[j - 1] in "eE" and t[j + 1 : j + 2].isdigit()
                if t[j] in SEPARATORS and not inside_id:
                    break
                j += 1
            tokens.append(("v", t[i:j], False))
            i = j
    values, expect = [], True
    for n, x in enumerate(tokens):
        if x[0] == "v":
            if not expect:
                return None
            values.append(x[1:])
            expect = False
        elif x[0] == "s":
            if expect:
                return None
            expect = True
        else:
            before = next((y for y in reversed(tokens[:n]) if y[0] != "b"), None)
            after = next((y for y in tokens[n:] if y[0] != "b"), None)
            if before and after and before[0] == "v" and after[0] == "v":
                expect = True
    if expect:
        return None
    return [y for y in (one(v.strip(), quoted, kind) for v, quoted in values)] if all(one(v.strip(), quoted, kind) is not None for v, quoted in values) else None


def one(v, quoted, kind):
    if kind == "event":
        if len(v) < 2 or v[0] not in "eE":
            return None
        j = 1
        while j < len(v) and not v[j].isalnum() and not v[j].isspace() and v[j] not in "[](){}<>":
            j += 1
        digits = v[j:]
        if not digits.isdigit() or not 1 <= int(digits) <= 29:
            return None
        return int(digits)
    if quoted:
        v = v.replace(",", ".")
    body = v[1:] if v[:1] in "+-" else v
    if not body or not all(ch in "0123456789." for ch in body) or body.count(".") > 1 or body == ".":
        return None
    x = float(v)
    return x if x >= 0 and math.isfinite(x) else None


def reason(features, interval, latency):
    events = read_list(features, "event")
    if not events:
        return "features"
    gaps = read_list(interval, "number")
    if gaps is None or len(gaps) != len(events) - 1:
        return "interval"
    try:
        x = float(latency) if not isinstance(latency, str) or all(ch in "0123456789.eE+- \t" for ch in latency) else None
    except (TypeError, ValueError):
        x = None
    if x is None or not math.isfinite(x) or x < 0 or abs(x - sum(gaps)) > 1e-6:
        return "latency"
    return None
