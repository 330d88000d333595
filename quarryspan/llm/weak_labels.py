"""Weak labels for residue of templates and for pages that are no content: response status, and phrases by family.

They only label a bounded sample from which the classifier learns. They are few and general: most wordings of
a message are not among them, and no row is found or let go by a phrase.
"""

from __future__ import annotations

from http import HTTPStatus

import regex

#: Reasons of failed requests, as the status codes define them.
_REASONS = "|".join(sorted({regex.escape(s.phrase.lower()) for s in HTTPStatus if s >= 400}))
_CODE = r"[45]\d\d"
# Elements of a page's text, which are markup and no placeholder.
ELEMENTS = "a abbr article aside audio b body br button cite code data div dl dt em figure footer form frame h1 h2 h3 h4 h5 h6 head header hr html i iframe img input label li link main mark menu meta nav ol option p pre s samp script section select small span strong style sub summary sup table tbody td template th thead time title tr u ul var video wbr"
_NAME = r"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z0-9_]+)*"
_TAG = rf"(?!/?(?:{'|'.join(ELEMENTS.split())})\b){_NAME}"

# Phrases by family. A family can be left out of the labels, to see whether the classifier finds it all the same.
STATUS = {
    "status": [rf"^(?:(?:http|error|status|code)\b\W*)*(?:{_CODE}\W*)?(?:{_REASONS})\b", rf"[(\-–:]\s*(?:\w+\s)?{_CODE}\)?\W*$", rf"^\{{\s*\"(?:status|code|error)\"\s*:\s*\"?{_CODE}", rf"<title>\s*{_CODE}"],
}
WHOLE = {
    "missing": [r"^(?:the |this )?(?:page|document|content)\b[^.!?]{0,30}\b(?:not found|no longer available)", r"^[^.!?]{0,40}(?:nicht gefunden|no encontrad[ao]|introuvable|nenašl[ao]|не найдена?)", "見つかりません"],
    "refused": [r"^(?:access|permission) (?:is |was )?(?:denied|refused)[.:!]", r"^(?:zugriff verweigert|acceso denegado|accès refusé)"],
    "failed": [r"^(?:unable to|could not|cannot) (?:load|display)\b", r"\btimed out\b"],
    "scripts": [r"^[^.!?\"“„«]{0,60}\b(?:enable|activate|turn on|activer|aktivieren sie|activar|zapnite|включите) (?:javascript|cookies|scripts)", r"^javascript is (?:disabled|required)", "javascriptを有効"],
    "visitor": [r"\byou are (?:a )?(?:human|robot)\b", r"^(?:please )?(?:sign|log) in to\b", r"^your session (?:has )?expired", r"^checking your browser"],
    "filler": [r"^lorem ipsum\b"],
    "repeated": [r"^(\w+(?: \w+)?)(?: \1)+\W*$"],
}
MARKS = {
    "braces": [rf"\{{\{{[#/]?\s*{_NAME}\s*\}}\}}", rf"\{{%\s*{_NAME}\s*%\}}", rf"[$#]\{{{_NAME}\}}", rf"(?<![{{$#]){{{_NAME}\}}(?!\}})"],
    "signs": [rf"@@{_NAME}@@", rf"__{_NAME}__", rf"\${_NAME}\$", rf"%%{_NAME}%%", rf"%\({_NAME}\)s"],
    "brackets": [rf"\[\[{_NAME}\]\]", rf"<%=?\s*{_NAME}\s*%>", rf"&lt;{_NAME}&gt;", rf"<{_TAG}>"],
    "prompts": [r"[\[<(](?:your|insert|add|enter|type|put|to be)\b[^\[\]<>()]{2,60}[\])>]", r"\b(?:TODO|FIXME|TBD)\b", r"\b(?:abstract|summary|text|description)[a-z ]{0,15} here\b", r"\b(?:type|enter|insert|paste) (?:the|your|an?) [^.!?]{2,40} here\b", r"\bX{3,}(?: X{3,})+\b", r"[\[<(][^\[\]<>()]{2,40}(?:einfügen|doplniť|compléter|completar|добавить)[\])>]", r"\[placeholder\b[^\]]*\]"],
}
FAMILIES = {**STATUS, **WHOLE, **MARKS}


class Labeller:
    """Weak labels by all families but some."""

    def __init__(self, without: frozenset[str] = frozenset()) -> None:
        def compiled(families: dict[str, list[str]]) -> regex.Pattern:
            # a group's number is that of its own pattern, so each pattern stands alone
            return [regex.compile(p, regex.I) for name, patterns in families.items() if name not in without for p in patterns]

        self.whole, self.marks = compiled({**STATUS, **WHOLE}), compiled(MARKS)

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Where placeholders lie in a text."""
        return sorted(m.span() for p in self.marks for m in p.finditer(text))

    def __call__(self, text: str | None) -> int:
        """2: placeholder; 1: no content as a whole; 0: no label; a null or blank text has none."""
        if not text or not text.strip():
            return 0
        text = text.strip()
        return 1 if any(p.search(text) for p in self.whole) else 2 if any(p.search(text) for p in self.marks) else 0


LABELLER = Labeller()
