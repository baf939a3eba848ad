"""Schemas of the tables, the vocabularies of their text columns, and parameter records."""

from __future__ import annotations

from dataclasses import dataclass, field

AVAILABILITY = ("in_stock", "out_of_stock", "low_stock", "unknown")
RETAIL_METHOD = ("structured_data", "availability_flag", "json_endpoint", "cart_probe", "html")
QUANT = ("f32", "int8", "binary")
SOURCE = ("local", "peer", "indexer")
VISIBILITY = ("terminating", "blind")


FETCHED_PAGE = "url string, status int, content_type string, body binary, fetched_at long"
CHUNK = "struct<ordinal:int,text:string>"
LINK = "struct<to_url:string,anchor:string,rel:string>"
WEB_DOC = f"url string, title string, snippet string, chunks array<{CHUNK}>, links array<{LINK}>, discovered array<string>, source_hash binary"
OBSERVATION = "store string, sku string, availability string, quantity long, price_minor long, currency string, method string, observed_at long"
RETAIL_OBSERVATION = OBSERVATION
WEB_OBSERVATION = "observer binary, seq long, url string, source_hash binary, observed_at long"
URL_ENTRY = "url string, id binary, last_crawled long, content_hash binary, last_embedded map<string,long>, applied array<string>"
URL_LIST = "id string, name string, publisher binary, version long, urls array<string>, body string, updated_at long"
INDEXED_DOC = f"url string, url_id binary, title string, snippet string, chunks array<{CHUNK}>, indexed_at long, source_hash binary"
SPACE = "id string, model_id string, dim int, quant string, default boolean"
VECTOR = "url_id binary, space string, values array<float>"
STORED_VECTOR = "struct<quant:string,f32:array<float>,i8:array<tinyint>,scale:float,bits:binary,dim:int>"
EDGE = "src string, dst string, pos int"
HIT = "url string, title string, snippet string, score double"
NODE = "node binary, subscribed_lists array<binary>, served_spaces array<string>, extractors array<string>, query_visibility string, updated_at long"
REJECT = "url string, extractor string, reason string"


@dataclass(frozen=True)
class QuorumParams:
    """How many distinct observers must agree, within which time, and how far counts may differ."""

    k: int = 3
    window_secs: int = 3600
    qty_tolerance: int = 2


@dataclass(frozen=True)
class FetchConfig:
    """Politeness limits of the fetcher."""

    user_agent: str = "tessera/0.1"
    timeout_secs: int = 20
    max_redirects: int = 5
    max_body_bytes: int = 8 * 1024 * 1024
    min_delay_secs: int = 2


@dataclass(frozen=True)
class EmbeddingSpace:
    """A vector space; its id says which model, how many dimensions and how values are stored."""

    model_id: str
    dim: int
    quant: str = "f32"
    default: bool = False
    id: str = field(init=False)

    def __post_init__(self) -> None:
        if self.quant not in QUANT:
            raise ValueError(f"quant must be one of {QUANT}")
        object.__setattr__(self, "id", f"{self.model_id}@{self.dim}/{self.quant}")


def default_node(node: bytes, url_list: bytes, space: str, now: int) -> dict:
    """A participant with one list and one space that runs the web extractor and ends queries itself."""
    return {"node": node, "subscribed_lists": [url_list], "served_spaces": [space], "extractors": ["web"], "query_visibility": VISIBILITY[0], "updated_at": now}
