"""One reading of characters that look alike or can't be seen, by table."""

from __future__ import annotations

import re
import unicodedata

# Letters of other scripts drawn like a Latin letter, and that letter.
CYRILLIC = "аa еe оo рp сc уy хx ѕs іi јj ѵv һh ԁd ԛq ԝw үy АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ѴV ԚQ ԜW ҮY"
GREEK = "αa γy ιi νv οo ρp υu ϲc ϳj ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ͿJ"
ARMENIAN = "օo սu ոn հh ցg զq յj ՕO ՍU"
CHEROKEE = "ᎪA ᎫJ ᎬE ᎳW ᎷM ᎻH ᎽY ᏀG ᏃZ ᏒR ᏙV ᏚS ᏞL ᏟC ᏢP ᏦK ᏴB"
LISU = "ꓐB ꓑP ꓓD ꓔT ꓖG ꓗK ꓙJ ꓚC ꓜZ ꓝF ꓟM ꓠN ꓡL ꓢS ꓣR ꓦV ꓧH ꓪW ꓫX ꓬY ꓮA ꓰE ꓲI ꓳO ꓴU"
OTHER = "ɡg ɑa ᴏo ᴄc ꜱs ᴠv ᴡw ᴢz ӀI ӏl ǀl ‐- ‑- ﹣- ˗-"
# Letters drawn like more than one Latin letter: the one taken where no word decides, and the others.
SEVERAL = "ӀIl ӏlI ǀlI υuv ѵvu"
# Characters drawn as nothing (Default_Ignorable_Code_Point).
UNSEEN = r"\xad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\ufff9-\ufffb\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff"
# Spaces of any width, the tab among them, but no line break.
SPACES = r"\t \xa0\u1680\u2000-\u200a\u202f\u205f\u3000"

LATIN = {ord(pair[0]): pair[1] for line in (CYRILLIC, GREEK, ARMENIAN, CHEROKEE, LISU, OTHER) for pair in line.split()}
_UNSEEN, _SPACES = re.compile(f"[{UNSEEN}]+"), re.compile(f"[{SPACES}]")
OTHERS = {x[0]: x[2:] for x in SEVERAL.split()}
#: Letters that ``SEVERAL`` confuses with each other, as one of them.
_ALIKE = str.maketrans({c: x[1] for x in ("Il", "vu") for c in x[0]})
#: Full-width and half-width forms, ligatures, Roman numeral signs and letters of formulas: read like their compatibility form.
_FORMS = re.compile(r"[\uff01-\uff9f\uffa1-\uffee\ufb00-\ufb06\u2160-\u217f\U0001d400-\U0001d7ff]+")
#: A run of characters beyond ASCII with the character before it, which they may combine with.
_RUN = re.compile(r"[\x00-\x7f]?[^\x00-\x7f]+")
_TAB = str.maketrans("\t", " ")
KEPT = 200_000
_known: dict[str, str] = {}


def unseen_out(text: str) -> str:
    """``text`` without the characters that are drawn as nothing."""
    return text if text.isascii() else _UNSEEN.sub("", text)


def _read(run: str) -> str:
    known = _known.get(run)
    if known is None:
        s = _SPACES.sub(" ", _UNSEEN.sub("", run))
        s = _FORMS.sub(lambda m: unicodedata.normalize("NFKC", m[0]), s)
        known = unicodedata.normalize("NFC", unicodedata.normalize("NFD", s).translate(LATIN))
        if len(_known) >= KEPT:
            _known.clear()
        _known[run] = known
    return known


def reading(text: str) -> str:
    """The one form of all texts that read like ``text``, letter by letter.

    Unseen characters are left out, spaces become the usual one, full-width
    forms and ligatures their plain letters, look-alikes their Latin letter,
    accents are composed. Letter case, accents, digits and line breaks stay.
    """
    if text.isascii():
        return text.translate(_TAB)
    # a mark may stand behind an unseen character, so these go first
    return _RUN.sub(lambda m: _read(m[0]), _UNSEEN.sub("", text)).translate(_TAB)


def skeleton(word: str) -> str:
    """The same for all words that a token may be read as."""
    return reading(word).translate(_ALIKE)


def arcs(c: str) -> tuple[str, ...]:
    """What a character may be read as, decomposed: the table's reading first."""
    first = unicodedata.normalize("NFD", _read(c) if c > "\x7f" else c)
    return (first, *OTHERS.get(c, ()))
