"""Inspected examples: short texts in the shapes that plant documents come in, each with the kind a reader gives it."""

_EN = [
    "The cooling water pump ran for 45 hours after the repair. No further leak was seen once the shaft seal had been replaced, although the suction pressure fell to 2.4 bar during the night.",
    "According to the shift report, the operator closed the inlet valve before the alarm was cleared. It was agreed that the gasket had been fitted dry. The line will be inspected again in the second week.",
    "If the bearing reaches 85.5 °C, the shift supervisor must stop the compressor and inform the maintenance planner. The vendor reported 12 mm/s at P-4410B, which is above the limit of 7.1 mm/s.",
]
_OTHER = [
    "Nach 300 Stunden wurde die Pumpe in der Halle geprüft, und der Techniker fand keine Leckage. Der Druck ist auf 3 bar zu senken, wenn die Anlage steht. Die Ersatzteile für P-100 liegen im Lager.",
    "Après 200 heures, le technicien a contrôlé la vanne et n'a plus observé de fuite. La pression est de 4 bar et les pièces pour P-200 sont dans le magasin. Il est recommandé de vérifier le joint.",
    "Después de la prueba, el operador revisó la bomba y ya no encontró una fuga. La presión llegó a 5 bar en la sala y los repuestos para P-300 están en el almacén. Se recomienda comprobar la junta.",
]
_HAN = "操作工在泵房巡检时发现给水泵P-1200出现泄漏。根据手册，密封应每90天检查一次。由于温度过高，轴承需要在30天内更换。"


def _wrapped(text: str, width: int) -> str:
    out, line = [], ""
    for word in text.split():
        if line and len(line) + len(word) >= width:
            out.append(line)
            line = word
        else:
            line = f"{line} {word}".strip()
    return "\n".join([*out, line])


_ITEMS = ["a worn seal", "cavitation", "a bent shaft", "loose bolts", "low flow", "noise", "a blocked filter", "corrosion", "a hot bearing", "leakage", "an open drain", "drift"]
_PARTS = ["shaft seal P-4410B", "impeller P-120", "gasket XV-310", "oil filter K-77", "drive belt M-5101", "coupling K-908", "valve stem XV-21", "bearing P-4411", "level gauge TK-80", "fan blade M-62"]
_VALUES = ["seal: 12 mm", "impeller: 4.5 bar", "gasket: 80 °C", "filter: 3.1 kPa", "belt: 12 Nm", "coupling: 9 mm/s", "stem: 2 A", "bearing: 61 °C", "gauge: 7 rpm", "blade: 8.8 kW"]
_CELLS = [["2024-05-0%d" % i, "P-44%d0" % i, "normal", "%d.%d bar" % (i, i), str(1000 + 37 * i)] for i in range(1, 9)]
_HEAD = ["date", "tag", "status", "value", "count"]
_RULE = "+" + "------------+" * 5
_NOISE = "{}[]~^|<>#$%&*_=+/@!;:"
_SIGNS = "".join(_NOISE[(7 * i * i + 3 * i) % len(_NOISE)] + (" " if i % 9 == 4 else "\n" if i % 31 == 30 else "") for i in range(400))
_BASE = "".join("kJ7bQ2xLm9TzR4vYw0NcF1sHdG8pUe5aB6oViE3qXtKCyDrW"[(11 * i * i + 5 * i) % 48] + ("\n" if i % 70 == 69 else "") for i in range(600))
_BYTES = "0123456789abcdef"
_HEX = "\n".join("%08x  " % (16 * r) + " ".join(_BYTES[(5 * r + 3 * i) % 16] + _BYTES[(7 * i + r * i) % 16] for i in range(16)) for r in range(14))
_MOJIBAKE = "".join("Ã¢â€™ÂœŸ§¶¤ðeirst"[(13 * i * i + i) % 17] + (" " if i % 23 == 22 else "") for i in range(500))
_SCRAP = " ".join(("&nbsp;", "&amp;", "&lt;", "&quot;")[i % 4] + ("</p>", "<br>", "<div>", "</td>", "<span>")[i % 5] for i in range(60))
_MIXED = "".join(c + (_NOISE[(i * i) % len(_NOISE)] if i % 2 else "") for i, c in enumerate(" ".join(_EN)[:300]))

EXAMPLES = (
    *[("prose", "plain", " ".join(_EN[i:] + _EN[:i])) for i in range(3)],
    ("prose", "plain", " ".join(_EN).lower()),
    ("prose", "plain", _EN[0]),
    *[("prose", "other", " ".join([t] * 3)) for t in _OTHER],
    *[("prose", "wrapped", _wrapped(" ".join(t), w)) for t in (_EN, _OTHER) for w in (50, 64, 90)],
    *[("prose", "narrow", _wrapped(" ".join(t), w)) for t in (_EN, _OTHER) for w in (26, 32, 38)],
    ("prose", "dialogue", "\n".join(("Operator: " if i % 2 else "Assistant: ") + t for i, t in enumerate(_EN * 2))),
    ("prose", "sections", "# Inspection\n\n1. SUMMARY\n" + "\n\n".join(_EN) + "\n\n2. RESULT\n" + _EN[0]),
    ("prose", "sections", "REVIEW\n\n1. SUMMARY\n" + "\n- ".join(_EN)),
    ("prose", "with entries", " ".join(_EN) + "\n- " + "\n- ".join(_VALUES[:5]) + "\n" + " ".join(_EN[:2])),
    ("prose", "with cells", " ".join(_EN * 2) + "\n" + "\n".join(",".join(c) for c in _CELLS[:4])),
    ("prose", "han", _HAN * 3),
    ("prose", "han", _HAN + "\n\n" + _HAN),
    ("list", "bullets", "Open points:\n" + "\n".join("- " + x for x in _ITEMS)),
    ("list", "bullets", "\n".join("- " + x + (".", ";", "")[i % 3] for i, x in enumerate(_PARTS))),
    ("list", "bullets", "\n".join("[x] %d x %s" % (i + 2, x.split()[0]) for i, x in enumerate(_PARTS))),
    ("list", "numbered", "\n".join("%d. %s" % (i + 1, x) for i, x in enumerate(_PARTS))),
    ("list", "numbered", "Tags:\n" + "\n".join("%d) %s" % (i + 1, x.replace(":", ",")) for i, x in enumerate(_VALUES))),
    ("list", "plain", "Spare parts:\n" + "\n".join(_ITEMS)),
    ("list", "plain", "\n".join(_ITEMS)),
    ("list", "values", "\n".join(_VALUES)),
    ("list", "enumeration", ", ".join(_ITEMS * 2)),
    ("list", "enumeration", "Checklist:\n" + "; ".join(_PARTS)),
    ("list", "bullets after text", _EN[0] + "\n" + "\n".join("- " + x for x in _ITEMS * 2)),
    ("list", "enumeration after text", _EN[2] + "\n" + ", ".join(_ITEMS * 3)),
    ("list", "han", "\n".join("- " + x for x in ("给水泵", "冷却塔", "储罐", "离心机", "调节阀", "搅拌器", "分离器", "冷凝器"))),
    ("table", "bars", "| " + " | ".join(_HEAD) + " |\n| --- | --- | --- | --- | --- |\n" + "\n".join("| " + " | ".join(c) + " |" for c in _CELLS)),
    ("table", "bars", (_RULE + "\n").join("|" + "|".join(x.center(12) for x in c) + "|\n" for c in _CELLS)),
    *[("table", "separated", "\n".join(mark.join(c) for c in [_HEAD, *_CELLS])) for mark in (",", ";")],
    ("table", "aligned", "\n".join("  ".join(x.ljust(12) for x in c) for c in [_HEAD, *_CELLS])),
    ("table", "aligned", "\n".join("\t".join(c) for c in [_HEAD, *_CELLS])),
    ("table", "separated after text", _EN[0] + "\n\n" + "\n".join(",".join(c) for c in [_HEAD, *_CELLS, *_CELLS])),
    ("table", "bars after text", _EN[2] + "\n\n" + "\n".join("| " + " | ".join(c) + " |" for c in _CELLS * 2)),
    ("junk", "signs", _SIGNS),
    ("junk", "signs", _MIXED),
    ("junk", "encoded", _BASE),
    ("junk", "encoded", _HEX),
    ("junk", "mojibake", _MOJIBAKE),
    ("junk", "scrap", _SCRAP),
    ("junk", "repeated", "P-4410B " * 80),
    ("junk", "repeated", "seal seal " * 50),
    ("junk", "repeated lines", "P-4410B\n" * 60),
    ("junk", "repeated lines", "seal\n" * 60),
    ("junk", "repeated lines", "shaft seal\n" * 50),
    ("junk", "repeated entries", "P-4410B, " * 60),
    ("junk", "repeated entries", "shaft seal, " * 50),
    ("junk", "consonants", " ".join("bcdfghjklmnpqrstvwxz"[(3 * i * i + i) % 20 : (3 * i * i + i) % 20 + 3 + i % 6] + "kzrt"[: i % 4] for i in range(90))),
    ("junk", "after text", _EN[0] + "\n" + _SIGNS),
)
