"""File names of rows: how a key spells a name, and back."""

from __future__ import annotations

import re
import unicodedata
from urllib.parse import quote, unquote_to_bytes

# Device names that some systems reserve, and bytes written as they are.
DEVICES = frozenset({"con", "prn", "aux", "nul", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10))})
SAFE = "_-."
LONGEST = 255


class NameError_(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def percent(text: str) -> str:
    """A key's text with all but letters, digits and ``_-.`` as ``%HH``."""
    out = quote(text, safe=SAFE).replace("~", "%7E")
    if out.startswith("."):
        out = "%2E" + out[1:]
    if out.endswith("."):
        out = out[:-1] + "%2E"
    if out.split(".")[0].lower() in DEVICES:
        out = f"%{ord(out[0]):02X}" + out[1:]
    return out


def alphabet(spec: str) -> re.Pattern:
    """A character class of single characters and ranges."""
    body = re.sub(r"\\u\{([0-9A-Fa-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), spec).replace("[", r"\[").replace("]", r"\]").replace("^", r"\^")
    return re.compile(f"[{body}]*")


def spell(values: list[object], rule: dict) -> str:
    """The file name (without ``.json``) of a key under a naming rule."""
    kind = rule.get("rule", "percent")
    texts = [str(v) for v in values]
    if kind == "template":
        name = rule.get("prefix", "") + spell(values, rule["inner"]) + rule.get("suffix", "")
    elif kind == "verbatim":
        if len(texts) != 1 or not alphabet(rule["alphabet"]).fullmatch(texts[0]):
            raise NameError_("FILENAME_RULE_UNDETERMINED", f"{texts} needs characters outside {rule.get('alphabet')!r}")
        name = texts[0]
    else:
        name = ",".join(map(percent, texts))
    if not name or name.startswith(".") or "/" in name or "\0" in name:
        raise NameError_("FILENAME_RULE_UNDETERMINED", f"{name!r} is no file name")
    if len((name + ".json").encode()) > LONGEST:
        raise NameError_("FILENAME_TOO_LONG", f"{name[:40]!r}...")
    return name


def read(name: str, rule: dict) -> list[str]:
    """The key's texts that a file name spells."""
    kind = rule.get("rule", "percent")
    if kind == "template":
        head, tail = rule.get("prefix", ""), rule.get("suffix", "")
        if not (name.startswith(head) and name.endswith(tail) and len(name) >= len(head) + len(tail)):
            raise NameError_("IDENTITY_MISMATCH", f"{name!r} isn't of the form {head}...{tail}")
        return read(name[len(head) : len(name) - len(tail)], rule["inner"])
    if kind == "verbatim":
        return [name]
    return [unquote_to_bytes(x).decode("utf-8") for x in name.split(",")]


def fold(name: str) -> str:
    """What names that some file systems can't tell apart have in common."""
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", name).casefold())
