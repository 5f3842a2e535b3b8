"""The contract of the secret scan, written out in plain Python."""

import hashlib
import re

PATTERNS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    ("access", re.compile(r"(AKIA[A-Z0-9]+)"), 1, 18),
    ("hex", re.compile(r"([0-9a-f]+)"), 1, 16),
)


def base(text):
    spans = []
    for rank, (name, pattern, group, least) in enumerate(PATTERNS):
        spans += [(m.start(), rank, m.end(), name) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    spans.sort()
    counts = [sum(s[1] == r for s in spans) for r in range(3)]
    joined = ",".join(f"{s[3]}:{s[0]}:{s[2]}" for s in spans)
    return (*counts, hashlib.sha256(joined.encode()).hexdigest())
