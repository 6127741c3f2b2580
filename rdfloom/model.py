"""Paths of predicates from a model in YAML: subjects with nested lists of properties.

model.yaml lists subjects with their properties; a property whose value is a blank
node ([]) nests. Every chain of two or more predicates below a subject is a path
worth materialising. prefix.yaml maps prefixes to IRIs.
"""

from __future__ import annotations

from pathlib import Path

MARKS = "+*?"


def prefixes(data: dict) -> dict[str, str]:
    return {str(k): str(v).strip().removeprefix("<").removesuffix(">") for k, v in (data or {}).items()}


def expand(name: str, known: dict[str, str]) -> str | None:
    """IRI of a predicate name, without its cardinality; None where it is none."""
    name = str(name).strip().rstrip(MARKS)
    if name.startswith("<") and name.endswith(">"):
        return name[1:-1]
    prefix, colon, local = name.partition(":")
    return known[prefix] + local if colon and prefix in known else None


def _items(node) -> list[tuple]:
    if isinstance(node, dict):
        return list(node.items())
    return [pair for x in node or [] if isinstance(x, dict) for pair in x.items()] if isinstance(node, list) else []


def _walk(node, known: dict[str, str], chain: tuple[str, ...], out: list[list[str]]) -> None:
    for name, value in _items(node):
        iri = expand(name, known)
        if iri is None:
            if str(name).strip() == "[]":
                _walk(value, known, chain, out)
            continue
        own = (*chain, iri)
        if len(own) > 1 and list(own) not in out:
            out.append(list(own))
        _walk(value, known, own, out)


def paths(model, prefix: dict) -> list[list[str]]:
    """Chains of predicates, shortest first."""
    known, out = prefixes(prefix), []
    for _, properties in _items(model):
        _walk(properties, known, (), out)
    return sorted(out, key=len)


def load(text: str):
    """YAML whose keys may be lists: a blank node's [] is the key "[]"."""
    import yaml

    class Loader(yaml.SafeLoader):
        pass

    def mapping(loader: yaml.SafeLoader, node: yaml.MappingNode) -> dict:
        loader.flatten_mapping(node)
        keys = [loader.construct_object(k, deep=True) for k, _ in node.value]
        return {str(k) if isinstance(k, list | dict) else k: loader.construct_object(v, deep=True) for k, (_, v) in zip(keys, node.value)}

    Loader.add_constructor("tag:yaml.org,2002:map", mapping)
    return yaml.load(text, Loader)  # noqa: S506  a safe loader


def _text(at: str) -> str:
    """A file's text; at: a path or an http(s) address."""
    if at.startswith(("http://", "https://")):
        from urllib.request import urlopen

        with urlopen(at, timeout=30) as got:
            return got.read().decode("utf-8")
    return Path(at).read_text()


def read(folder: str) -> list[list[str]]:
    """Paths of model.yaml and prefix.yaml in a folder, or below an http(s) address."""
    at = folder.rstrip("/")
    return paths(load(_text(f"{at}/model.yaml")), load(_text(f"{at}/prefix.yaml")))


def sub_paths(chain: list[str]) -> list[list[str]]:
    """Contiguous parts of two or more predicates, shortest first."""
    return sorted((chain[i:j] for i in range(len(chain)) for j in range(i + 2, len(chain) + 1)), key=len)
