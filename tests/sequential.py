"""A plain sequential masker: the definition, line by line, rule by rule.

Placeholders are protected from later rules, which is the one intended
difference from the described behaviour.
"""

import re


def mask(text, rules, seed=(), counter=0):
    """rules: (id, pattern, template, counted). Returns (masked, mapping, count)."""
    table = {o: m for o, m, _ in seed}
    mapping = list(seed)
    count = 0
    out = []
    for line in re.split(r"(?<=\n)", text):
        parts = [(line, False)]
        for rule_id, pattern, template, counted in rules:
            nxt = []
            for part, done in parts:
                if done:
                    nxt.append((part, True))
                    continue
                at = 0
                for m in re.finditer(pattern, part, re.ASCII):
                    nxt.append((part[at:m.start()], False))
                    original = m.group(0)
                    count += 1
                    if original not in table:
                        if counted:
                            counter += 1
                            table[original] = f"{template}{counter}"
                        else:
                            table[original] = template
                        mapping.append((original, table[original], rule_id))
                    nxt.append((table[original], True))
                    at = m.end()
                nxt.append((part[at:], False))
            parts = nxt
        out.append("".join(p for p, _ in parts))
    return "".join(out), mapping, count
