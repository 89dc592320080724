"""Plain Python versions of operators, for small inputs."""

import json
import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

ARRAYS = {"violations", "evidence", "spans", "related", "reviews", "comments", "replies"}


def opened(v):
    while isinstance(v, str):
        try:
            v = json.loads(v)
        except ValueError:
            return None
    return v


def nodes(name, v, base=""):
    v = opened(v)
    v = [v] if isinstance(v, dict) else v
    out = []
    if isinstance(v, list):
        for i, e in enumerate(v, 1):
            if isinstance(e, dict):
                path = f"{base}{name}[{i}]"
                out.append(path)
                for k, x in e.items():
                    if k in ARRAYS:
                        out += nodes(k, x, path + ".")
    return out


def audit_nodes(row):
    out = []
    for i, v in enumerate(row["violations"] or [], 1):
        if v is not None:
            out.append(f"violations[{i}]")
            inner = opened(v["context"])
            if isinstance(inner, dict):
                for k, x in inner.items():
                    if k in ARRAYS:
                        out += nodes(k, x, f"violations[{i}].")
    meta = dict(row["metadata"] or {})
    if meta.get("reviews") is not None:
        out += nodes("reviews", meta["reviews"])
    return out


NAMES = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
FIX = {"Z": 0, "UTC": 0, "GMT": 0, "CET": 1, "CEST": 2, "EST": -5, "EDT": -4, "PST": -8, "JST": 9}
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def utc_us(value, tz, order):
    v = (value or "").strip()
    if re.fullmatch(r"\d{10}(\.\d+)?", v):
        whole, _, frac = v.partition(".")
        return int(whole) * 10**6 + int((frac + "000000")[:6])
    if re.fullmatch(r"\d{13}", v):
        return int(v) * 1000
    zone = None
    if m := re.search(r"\[(.+)\]$", v):
        zone, v = m[1], v[: m.start()]
    elif m := re.search(r"(?<=[\d:\sMm])\s*([+-]\d\d):?(\d\d)$", v):
        if ":" in v[: m.start()]:
            sign = -1 if m[1][0] == "-" else 1
            zone, v = timezone(sign * timedelta(hours=int(m[1][1:]), minutes=int(m[2]))), v[: m.start()]
    elif m := re.search(r"(?<=[\dMm])\s*(Z|UTC|GMT|CET|CEST|EST|EDT|PST|JST)$", v, re.I):
        zone, v = timezone(timedelta(hours=FIX[m[1].upper()])), v[: m.start()]
    v = re.sub(r"^[A-Za-z]{3}, ", "", v).strip().replace(" at ", " ")
    pm = re.search(r" ([AP])M$", v)
    v = v[: pm.start()] if pm else v
    if m := re.fullmatch(r"(\d{4})-?(\d\d)-?(\d\d)(?:[T ](.*))?", v):
        y, mo, d, t = m.groups()
    elif m := re.fullmatch(r"(\d\d?)/(\d\d?)/(\d{4})(?:,? (.*))?", v):
        a, b, y, t = m.groups()
        if order not in ("dmy", "mdy"):
            return None
        d, mo = (a, b) if order == "dmy" else (b, a)
    elif m := re.fullmatch(r"(\d\d?)\.(\d\d?)\.(\d{4})(?: (.*))?", v):
        d, mo, y, t = m.groups()
    elif m := re.fullmatch(r"(\d\d?)[ -]([A-Za-z]+)[ -](\d{4})(?:,? (.*))?", v):
        d, mo, y, t = m.groups()
    elif m := re.fullmatch(r"([A-Za-z]+) (\d\d?), (\d{4})(?: (.*))?", v):
        mo, d, y, t = m.groups()
    else:
        return None
    mo = NAMES.get(mo[:3].lower()) if mo.isalpha() else int(mo)
    h = mi = s = us = 0
    if t:
        m = re.fullmatch(r"(\d\d?):?(\d\d)(?::?(\d\d)(?:[.,](\d+))?)?", t.strip())
        if not m:
            return None
        h, mi, s, us = int(m[1]), int(m[2]), int(m[3] or 0), int(((m[4] or "") + "000000")[:6])
        if pm:
            h = h % 12 + (12 if pm[1] == "P" else 0)
    try:
        local = datetime(int(y), mo or 0, int(d), h, mi, s, us)
    except ValueError:
        return None
    if zone is None:
        if not tz:
            return None
        zone = tz
    if isinstance(zone, str):
        zone = ZoneInfo(zone)
    # fold 0: the earlier instant of a repeated time; a skipped time moves forward
    return (local.replace(tzinfo=zone, fold=0) - EPOCH) // timedelta(microseconds=1)
