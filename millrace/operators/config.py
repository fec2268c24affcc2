"""Job configurations: a list of jobs in a subset of YAML, and templates in XML."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Mapping

from millrace.operators.jobs import JobSpec

_NAME = re.compile(r"[a-zA-Z0-9_.]+\Z")


class ConfigError(ValueError):
    """A configuration that can't be used."""


class MissingParameter(ConfigError):
    """A template's required parameter wasn't given."""


class UnexpectedParameter(ConfigError):
    """A parameter was given that the template doesn't have."""


def _scalar(text: str) -> str:
    text = text.strip()
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'" else text


def _block(lines: list[tuple[int, str]], at: int, indent: int) -> tuple[object, int]:
    """The value whose lines start at the given indent: a list, or a mapping."""
    is_list = lines[at][1].startswith("- ") or lines[at][1] == "-"
    out: list | dict = [] if is_list else {}
    while at < len(lines) and lines[at][0] == indent and (lines[at][1].startswith("- ") or lines[at][1] == "-") == is_list:
        text = lines[at][1]
        if is_list:
            rest = text[1:].lstrip()
            inner = indent + len(text) - len(rest)
            if rest and not re.match(r"[^\s:]+:(\s|$)", rest):
                out.append(_scalar(rest))
                at += 1
                continue
            if rest:
                lines[at] = (inner, rest)
            else:
                at += 1
                inner = lines[at][0] if at < len(lines) else indent + 1
            value, at = _block(lines, at, inner)
            out.append(value)
        else:
            key, colon, rest = text.partition(":")
            if not colon:
                raise ConfigError(f"not a mapping: {text}")
            if key in out:
                raise ConfigError(f"given twice: {key}")
            at += 1
            if rest.strip():
                out[key] = _scalar(rest)
            elif at < len(lines) and (lines[at][0] > indent or lines[at][0] == indent and lines[at][1].startswith("-")):
                out[key], at = _block(lines, at, lines[at][0])
            else:
                out[key] = None
    if at < len(lines) and lines[at][0] > indent:
        raise ConfigError(f"unexpected indentation: {lines[at][1]}")
    return out, at


def parse_yaml(text: str) -> dict:
    """One document of block mappings, block lists and plain or quoted scalars; scalars are strings."""
    lines = []
    for raw in text.splitlines():
        if raw.strip() in ("---", "..."):
            if lines:
                raise ConfigError("more than one document")
            continue
        bare = re.sub(r"(^|\s)#.*", "", raw).rstrip()
        if bare.strip():
            lines.append((len(bare) - len(bare.lstrip()), bare.strip()))
    if not lines:
        return {}
    value, at = _block(lines, 0, lines[0][0])
    if at < len(lines):
        raise ConfigError(f"can't be read: {lines[at][1]}")
    return value


def _params(entry: list | None) -> dict:
    out = {}
    for p in entry or []:
        if not _NAME.match(p.get("name") or ""):
            raise ConfigError(f"bad parameter name: {p.get('name')!r}")
        out[p["name"]] = p.get("default") or p.get("value")
    return out


def load_jobs(text: str) -> list[dict]:
    """The jobs under the key mapreduce: name, mapper (handler, input_reader, params, params_validator), params, params_validator."""
    found = parse_yaml(text).get("mapreduce") or []
    out, seen = [], set()
    for job in found:
        mapper = job.get("mapper") or {}
        if isinstance(mapper, list):  # entries of a list, merged
            mapper = {k: v for part in mapper for k, v in part.items()}
        if not job.get("name"):
            raise ConfigError("a job has no name")
        if job["name"] in seen:
            raise ConfigError(f"two jobs are called {job['name']}")
        seen.add(job["name"])
        if missing := [k for k in ("handler", "input_reader") if not mapper.get(k)]:
            raise ConfigError(f"{job['name']}: no {missing[0]}")
        config = {"name": job["name"], "mapper_handler": mapper["handler"], "mapper_input_reader": mapper["input_reader"]}
        if mapper.get("params_validator"):
            config["mapper_params_validator"] = mapper["params_validator"]
        if mapper.get("params"):
            config["mapper_params"] = _params(mapper["params"])
        if job.get("params"):
            config["params"] = _params(job["params"])
        out.append(config)
    return out


def spec_of(config: dict, given: Mapping[str, str] | None = None) -> JobSpec:
    """A job's spec, with the parameters given in place of the configured ones."""
    form = {k: v for k, v in config.items() if isinstance(v, str)}
    form |= {f"mapper_params.{k}": v for k, v in config.get("mapper_params", {}).items()} | {f"params.{k}": v for k, v in config.get("params", {}).items()}
    return JobSpec.from_form(form | dict(given or {}))


class Template:
    """A configuration in XML whose properties may be left to the caller: template="required", or "optional" with a default."""

    def __init__(self, xml: str | ET.Element) -> None:
        self.root = ET.fromstring(xml) if isinstance(xml, str) else xml
        self._used = False

    def _properties(self):  # noqa: ANN202
        for p in self.root.iter("property"):
            name, value = p.find("name"), p.find("value")
            if name is None or value is None:
                raise ConfigError("a property needs a name and a value")
            yield name, value, (name.text or "").strip()

    def parameters(self) -> dict[str, dict]:
        """Name, name for people and default of each property that is a parameter."""
        return {key: {"name": key, "human_name": name.get("human") or key, **({"default": value.text or ""} if value.get("template") == "optional" else {})} for name, value, key in self._properties() if value.get("template")}

    def fill(self, given: Mapping[str, str]) -> dict[str, str]:
        """All properties, the parameters filled in; once only."""
        if self._used:
            raise RuntimeError("a template is filled once")
        self._used = True
        if extra := given.keys() - self.parameters().keys():
            raise UnexpectedParameter(f"no such parameters: {', '.join(sorted(extra))}")
        out = {}
        for _, value, key in self._properties():
            if value.get("template") == "required" and key not in given:
                raise MissingParameter(f"not given: {key}")
            out[key] = given[key] if value.get("template") and key in given else value.text or ""
        return out


def load_templates(xml: str) -> dict[str, Template]:
    """Templates by the names of the configuration elements."""
    return {c.get("name"): Template(c) for c in ET.fromstring(xml).findall("configuration")}
