"""Drug pages: records and effects from HTML by the standard parser, in Arrow batches."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import page_text

RECORD = (
    "drug_name string, drug_class string, brand_names array<string>, prescribed_for array<string>, "
    "side_effects struct<mild: array<string>, serious: array<string>, total: int>, warnings array<string>"
)
EFFECTS = "common array<string>, serious array<string>, rare array<string>"
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
# What tells advice from effects and indications.
ADVICE = ["tell your doctor", "call your doctor", "if you experience", "medwatch", "emergency medical treatment", "doctor immediately", "serious side effect", "1-800", "food and drug administration", "fda", "call your"]
REFERRALS = ["ask your doctor", "talk to your doctor", "this medication may be prescribed", "for more information"]


class Node:
    def __init__(self, name: str, attrs: dict[str, str], parent: Node | None = None):
        self.name, self.attrs, self.parent, self.children = name, attrs, parent, []

    def walk(self):
        for child in self.children:
            if isinstance(child, Node):
                yield child
                yield from child.walk()

    def strings(self):
        for child in self.children:
            if isinstance(child, Node):
                if child.name not in ("script", "style"):
                    yield from child.strings()
            else:
                yield child

    def text(self, between: str = " ") -> str:
        return between.join(s for s in (x.strip() for x in self.strings()) if s)

    def find(self, test):
        return next((n for n in self.walk() if test(n)), None)

    def all(self, *names: str):
        return [n for n in self.walk() if n.name in names]


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.top = self.at = Node("", {})

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        up = self.at
        while up.parent is not None and up.name != tag:
            up = up.parent
        if up.parent is not None:
            self.at = up.parent

    def handle_data(self, data):
        self.at.children.append(data)


def tree(html: str) -> Node:
    parser = _Tree()
    parser.feed(html or "")
    parser.close()
    return parser.top


def _once(items: list[str]) -> list[str]:
    return list(dict.fromkeys(x for x in (i.strip() for i in items) if x))


def drug_record(html: str) -> dict:
    """What a monograph page says of its drug: sections are found by their ids."""
    page = tree(html)
    section = lambda name: page.find(lambda n: n.name == "div" and n.attrs.get("id") == name)
    title, why, effects, brands, warning = page.find(lambda n: n.name == "h1"), section("why"), section("side-effects"), section("brand-name-1"), section("section-warning")
    paragraphs = [page_text(p.text()) for p in why.all("p")] if why else []
    first = why.find(lambda n: n.name == "p") if why else None
    named = re.search(r"in a class of medications? called ([^.]+)\.", first.text(), re.IGNORECASE) if first else None
    found, kind = {"mild": [], "serious": []}, "mild"
    for tag in effects.all("h3", "ul", "p") if effects else []:
        if tag.name == "h3":
            kind = "serious" if "serious" in "".join(tag.strings()).lower() else "mild"
            continue
        for raw in [page_text(x.text()) for x in (tag.all("li") if tag.name == "ul" else [tag])]:
            if any(a in raw.lower() for a in ADVICE):
                continue
            if tag.name == "p" and (len(raw.split()) > 30 or len(raw) <= 5):
                continue
            by, most = (";", 15) if tag.name == "ul" else ("[;,]", 10)
            found[kind] += [s for s in (x.strip(" .,") for x in re.split(by, raw)) if len(s) > 3 and len(s.split()) <= most]
    mild, serious = _once(found["mild"]), _once(found["serious"])
    names = [re.sub(r"[§¶†‡*]", "", page_text(x.text())).strip() for x in brands.all("li")] if brands else []
    notes = [t for t in (page_text(x.text()) for x in warning.all("li")) if len(t) > 5] if warning else []
    notes += [t[:300] for t in (page_text(x.text()) for x in warning.all("p")) if len(t) > 20] if warning else []
    return {
        "drug_name": page_text(title.text("")) if title else "",
        "drug_class": named.group(1).strip() if named else "",
        "brand_names": _once([x for x in names if len(x) >= 2]),
        "prescribed_for": _once([p for p in paragraphs if len(p) >= 40 and not any(r in p.lower() for r in REFERRALS)]),
        "side_effects": {"mild": mild, "serious": serious, "total": len(mild) + len(serious)},
        "warnings": _once(notes),
    }


def _is(name: str, value: str):
    return lambda n: value in n.attrs.get(name, "").split()


#: Where a site keeps its effects: the first of these that a page has.
CONTAINERS = {
    "webmd": [("sideeffects", "monograph-content"), ("sideeffects", "side-effects-container"), (None, "monograph-content"), ("sideeffects", None)],
    "drugscom": [("sideEffects", None), (None, "sideEffects")],
}


def page_effects(html: str, site: str = "webmd") -> dict:
    """Effects by type: from the first heading on side effects to the next main heading on something else."""
    page, container = tree(html), None
    for by_id, by_class in CONTAINERS[site]:
        within = page.find(_is("id", by_id)) if by_id else page
        container = (within.find(_is("class", by_class)) if by_class else within) if within else None
        if container:
            break
    out, kind, started, seen = {"common": [], "serious": [], "rare": []}, "common", False, set()
    for node in container.all("h2", "h3", "h4", "li") if container else []:
        text = " ".join(node.text().split())
        low, heading = text.lower(), node.name != "li"
        if not text:
            continue
        started = started or (heading and "side effect" in low)
        if not started:
            continue
        if node.name == "h2" and "side effect" not in low:
            break
        if node.name in ("h2", "h3"):
            for name, words in (("serious", ("serious", "severe")), ("rare", ("rare", "less common")), ("common", ("side effect",))):
                if any(w in low for w in words):
                    kind = name
                    break
        elif not heading and len(text) < 250 and text not in seen:
            seen.add(text)
            out[kind].append(text)
    return out


def drug_records(pages: Column) -> Column:
    @F.pandas_udf(RECORD)
    def found(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([drug_record(x) for x in s], columns=["drug_name", "drug_class", "brand_names", "prescribed_for", "side_effects", "warnings"])

    return found(pages)


def effects(pages: Column, site: str = "webmd") -> Column:
    @F.pandas_udf(EFFECTS)
    def found(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([page_effects(x, site) for x in s], columns=["common", "serious", "rare"])

    return found(pages)
