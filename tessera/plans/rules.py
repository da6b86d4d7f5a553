"""The rule catalog: what is shipped, what users add, and which of it applies."""

from __future__ import annotations

import json
import logging
import re
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession

from ..functions import checks
from .ppr import RuleError, compile_rule

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Rule:
    id: str
    key: str
    type: str
    match: str
    lang: str = "common"
    context: tuple[str, ...] = ()
    group: str = ""
    country: tuple[str, ...] = ()
    imprecise: bool = False
    pii: bool = False
    minlen: int = 3
    maxlen: int = 100
    keywords: frozenset[str] = frozenset()
    regex: str | None = None
    func: str | None = None
    validator: str | None = None
    gate: str | None = None
    gate_keywords: frozenset[str] = frozenset()
    ord: int = field(default=0, compare=False)

    @property
    def gated(self) -> bool:
        return self.gate is not None or bool(self.gate_keywords)


def country_codes(value: str | Iterable[str] | None) -> tuple[str, ...]:
    """Codes from a list or from text parted by semicolons or commas; trimmed, in lower case."""
    if not value:
        return ()
    parts = re.split("[;,]", value) if isinstance(value, str) else [str(v) for v in value]
    return tuple(p.strip().lower() for p in parts if p.strip())


def _from_entry(e: dict, strict: bool) -> Rule:
    plain = {k: e[k] for k in ("id", "key", "type", "match", "lang", "group", "imprecise", "pii", "minlen", "maxlen", "func") if k in e}
    regex = e.get("regex") if strict else e.get("loose", e.get("regex"))
    gate = e.get("gate") if strict else e.get("gate_loose", e.get("gate"))
    return Rule(**plain, context=tuple(e["context"]), country=tuple(e.get("country", ())), keywords=frozenset(e.get("keywords", ())), gate_keywords=frozenset(e.get("gate_keywords", ())), regex=regex, gate=gate)


@lru_cache(maxsize=2)
def shipped(strict: bool = True) -> tuple[Rule, ...]:
    """The shipped rules. strict=False gives the rules that can't match as written (a doubled line end) their evident sense."""
    lines = (Path(__file__).parent / "catalog.jsonl").read_text("utf8").splitlines()
    return tuple(_from_entry(json.loads(x), strict) for x in lines)


def parsed(group: dict, strict: bool = True) -> list[Rule]:
    """The rules of one group in its written form: name, lang, context, country_code and rules by id. A rule that can't be read is logged and left out, an unreadable gate or validator only dropped."""
    out = []
    for ident, r in group["rules"].items():
        more: dict = {"minlen": int(r.get("minlen", 3)), "maxlen": int(r.get("maxlen", 100))}
        text = str(r["rule"])
        if r["match"] == "text":
            words = text.split(",")
            more = {"minlen": min(map(len, words)), "maxlen": max(map(len, words)), "keywords": frozenset(w.lower() for w in words)}
        elif r["match"] == "func":
            name = text.rsplit(".", 1)[-1]
            if name not in checks.CHECKS:
                log.warning("rule %s: no function %s; left out", ident, text)
                continue
            more["func"] = name
        else:
            try:
                more["regex"] = compile_rule(text, strict)
            except RuleError as e:
                log.error("rule %s: %s; left out", ident, e)
                continue
        if (v := str(r.get("validator", "")).rsplit(".", 1)[-1]) in checks.CHECKS:
            more["validator"] = v
        if "fieldrule" in r and r.get("fieldrulematch") == "text":
            more["gate_keywords"] = frozenset(w.lower() for w in r["fieldrule"].split(","))
        elif "fieldrule" in r and r.get("fieldrulematch") == "ppr":
            try:
                more["gate"] = compile_rule(r["fieldrule"], strict)
            except RuleError as e:
                log.error("gate of rule %s: %s; dropped", ident, e)
        out.append(Rule(id=ident, key=r["key"], type=r["type"], match=r["match"], lang=group["lang"], context=tuple(group["context"].split(".")), group=group["name"], country=country_codes(group.get("country_code")), imprecise=int(r.get("imprecise", 0)) != 0, pii=str(r.get("is_pii", "")).lower() == "true", **more))
    return out


def load(paths: Iterable[str] = (), strict: bool = True) -> list[Rule]:
    """Rules of YAML files and folders, by path and place in the file."""
    import yaml

    out: list[Rule] = []
    for p in map(Path, paths):
        for f in sorted(p.rglob("*.yaml")) if p.is_dir() else [p]:
            out += parsed(yaml.safe_load(f.read_text("utf8")), strict)
    return out


def catalog(rules: Iterable[Rule] | None = None, langs: Iterable[str] | None = None, contexts: Iterable[str] | None = None, countries: str | Iterable[str] | None = None, strict: bool = True) -> list[Rule]:
    """The rules in use, numbered: of one id the first; of the wanted groups' languages, contexts (the whole text) and countries, a group without countries being left out where some are wanted."""
    wanted = set(country_codes(countries))
    out: dict[str, Rule] = {}
    for r in shipped(strict) if rules is None else rules:
        if langs and r.lang not in set(langs) or contexts and ".".join(r.context) not in set(contexts) or wanted and not wanted & set(r.country):
            continue
        out.setdefault(r.id, r)
    return [Rule(**{**{k: getattr(r, k) for k in r.__dataclass_fields__}, "ord": n}) for n, r in enumerate(out.values())]


def applicable(rules: Iterable[Rule], type: str, contexts: Iterable[str] | None = None, langs: Iterable[str] | None = None, ignore_imprecise: bool = True) -> list[Rule]:
    """Rules of a type with any wanted context and a wanted language, without the imprecise ones unless they are asked for."""
    c, g = set(contexts or ()), set(langs or ())
    return [r for r in rules if r.type == type and (not c or c & set(r.context)) and (not g or r.lang in g) and not (ignore_imprecise and r.imprecise)]


FRAME = "ord int, id string, key string, type string, match string, lang string, context array<string>, `group` string, country array<string>, imprecise boolean, pii boolean, minlen int, maxlen int, n_keywords int, gated boolean"


def frame(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    return spark.createDataFrame([(r.ord, r.id, r.key, r.type, r.match, r.lang, list(r.context), r.group, list(r.country), r.imprecise, r.pii, r.minlen, r.maxlen, len(r.keywords), r.gated) for r in rules], FRAME)


def keyword_frame(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    return spark.createDataFrame([(r.ord, r.id, k) for r in rules for k in sorted(r.keywords)], "ord int, id string, keyword string")


def register_check(name: str, check: Callable[[Column], Column]) -> None:
    """Make a function from a text column to a boolean one usable as `match: func` or `validator`."""
    checks.CHECKS[name] = check


def as_dict(r: Rule) -> dict:
    return {k: sorted(v) if isinstance(v, frozenset) else v for k, v in asdict(r).items()}
