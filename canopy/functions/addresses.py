"""Names of remote objects: URLs, canonical URIs and queries, image references."""

from __future__ import annotations

from urllib.parse import quote

#: Characters besides letters and digits that stay in keys, and in queries.
KEY_SAFE = "!-_.*'()/"
QUERY_SAFE = "-._~"
DEFAULT_REGISTRY = "registry-1.docker.io"
LIBRARY_REGISTRIES = (DEFAULT_REGISTRY, "docker.io")


def _quoted(text: str, safe: str) -> str:
    return quote(text, safe=safe) if "~" in safe else quote(text, safe=safe).replace("~", "%7E")


def encode_key(key: str) -> str:
    return _quoted(key, KEY_SAFE)


def encode_query(text: str) -> str:
    return _quoted(text, QUERY_SAFE)


def canonical_query(params: dict[str, str]) -> str:
    """Encoded pairs, sorted by key."""
    return "&".join(f"{k}={v}" for k, v in sorted((encode_query(k), encode_query(v)) for k, v in params.items()))


def object_url(endpoint: str | None, bucket: str | None, key: str | None, virtual_host: bool, signature: int = 4) -> tuple[str, str]:
    """(URL, canonical URI) of an object or a bucket; endpoints without a scheme are https.

    A bucket that is missing or starts with a slash means that the endpoint's host names it. Raises ValueError where no URL can be made.
    """
    if endpoint is None:
        raise ValueError("no endpoint")
    scheme, found, host = endpoint.partition("://")
    if not found:
        scheme, host = "https", endpoint
    in_host = bucket is None or bucket.startswith("/")
    if in_host and not virtual_host:
        raise ValueError("no bucket")
    name, cut, rest = (bucket or "/").removeprefix("/").partition("/") if in_host else bucket.partition("/")
    inner = (bucket or "/")[1:] if in_host else rest
    if not virtual_host:
        path = "/" + bucket
    else:
        path = "/" + inner
        host = host if in_host else f"{name}.{host}"
    if key is not None:
        path = path.removesuffix("/") + "/" + encode_key(key)
    if signature == 4 or not virtual_host:
        return f"{scheme}://{host}{path}", path
    if in_host:
        name, dot, _ = host.partition(".")
        if not dot:
            raise ValueError("the host names no bucket")
    return f"{scheme}://{host}{path}", f"/{name}{path}"


def image_reference(ref: str, registry: str = DEFAULT_REGISTRY) -> tuple[str, str, str]:
    """(registry, repository, tag): a first part with a dot or colon is the registry; a bare name of the default one is in library/."""
    first, slash, rest = ref.partition("/")
    if slash and ("." in first or ":" in first):
        registry = first
    else:
        rest = ref
    repository, _, tag = rest.partition(":")
    if "/" not in repository and registry in LIBRARY_REGISTRIES:
        repository = f"library/{repository}"
    return registry, repository, tag or "latest"
