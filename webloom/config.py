"""Settings of a crawl and its audit; secrets are no part of them."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass

MODES = ("Crawl", "List", "Path", "Url")


@dataclass(frozen=True)
class AuditConfig:
    max_urls: int = 500
    max_concurrency: int = 4
    max_depth: int | None = None
    crawl_mode: str = "Crawl"
    respect_robots: bool = True
    follow_redirects: bool = True
    user_agent: str = "webloom/0.1"
    include_regex: str | None = None
    exclude_regex: str | None = None
    js_rendering: bool = False
    download_images: bool = False
    extract_microdata: bool = False
    project_dir: str | None = None
    ai_provider: str = "OpenAI"
    ai_model: str = "gpt-4o"
    md_only_main_content: bool = True
    md_keep_links: bool = True
    md_ignore_images: bool = False
    md_clean_whitespace: bool = True
    md_ignored_selectors: str = ""
    md_output_dir: str | None = None
    md_auto_generate: bool = False

    def __post_init__(self):
        if self.crawl_mode not in MODES:
            raise ValueError(f"crawl_mode must be one of {MODES}")

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self))

    @classmethod
    def from_json(cls, text: str) -> AuditConfig:
        names = {f.name for f in dataclasses.fields(cls)}
        return cls(**{k: v for k, v in json.loads(text).items() if k in names})
