"""Bringing public files in: where they are, which are new, and fetching them with care. Runs on the driver; only the bytes cross a network."""

from __future__ import annotations

import hashlib
import json
import random
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from pathlib import Path
from urllib.error import HTTPError, URLError
from urllib.parse import urljoin
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Public sources by tier, with format and how often they are renewed.
PUBLIC_SOURCES = [
    ("hhs_oig_leie_updated", "exclusions", "https://oig.hhs.gov/exclusions/downloadables/UPDATED.csv", "csv", "monthly"),
    ("hhs_oig_leie_reinstatements", "exclusions", "https://oig.hhs.gov/exclusions/downloadables/REIN.csv", "csv", "monthly"),
    ("sam_gov_exclusions", "exclusions", "https://sam.gov/data-services/Exclusions/Public%20V2?privacy=Public", "csv", "daily"),
    ("cms_nppes_downloads", "identity", "https://download.cms.gov/nppes/NPI_Files.html", "zip_csv", "weekly"),
    ("cms_public_provider_enrollment", "enrollment", "https://data.cms.gov/data.json", "csv", "quarterly"),
    ("hawaii_medquest_exclusions", "state", "https://medquest.hawaii.gov/en/plans-providers/provider-exclusion-reinstatement-list.html", "pdf", "monthly"),
]


def source_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PUBLIC_SOURCES, "source_id string, tier string, url string, format string, cadence string")


def links(pages: DataFrame, base: str, body: str, pattern: str) -> DataFrame:
    """``(<base>, pos, url)``: the link targets of pages that match a pattern, in their order; relative ones are left relative."""
    found = F.regexp_extract_all(F.col(body), F.lit(r"""(?i)href\s*=\s*["']?([^"'\s>]+)"""), F.lit(1))
    return pages.select(base, F.posexplode(found).alias("pos", "url")).where(F.col("url").rlike(pattern))


def absolute(base: str, url: str) -> str:
    return urljoin(base, url)


def catalogue_files(catalogue: DataFrame, text: str, ending: str = ".csv") -> DataFrame:
    """``(title, url)``: of every data set of a JSON catalogue the first file with that ending."""
    schema = "dataset array<struct<title: string, distribution: array<struct<downloadURL: string>>>>"
    sets = catalogue.select(F.explode(F.from_json(text, schema)["dataset"]).alias("d"))
    urls = F.filter(F.transform("d.distribution", lambda x: x["downloadURL"]), lambda u: F.endswith(F.lower(u), F.lit(ending)))
    return sets.select(F.lower(F.trim("d.title")).alias("title"), F.get(urls, 0).alias("url")).where("url is not null")


def remaining(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is wanted and not yet done (anti-join on distinct keys)."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")


@dataclass
class Outcome:
    url: str
    data: bytes | None = None
    error: str = ""

    @property
    def sha256(self) -> str:
        return hashlib.sha256(self.data).hexdigest() if self.data is not None else ""


@dataclass
class Fetcher:
    """Fetches one at a time, ``spacing`` seconds apart; transient failures are retried after growing pauses; too many failures in a row stop it.

    ``get`` brings the bytes of a URL, ``sleep`` and ``clock`` can be replaced in tests.
    """

    spacing: float = 0.5
    retries: int = 3
    pause: float = 1.0
    longest_pause: float = 30.0
    failures_allowed: int = 10
    get: Callable[[str], bytes] = lambda url: urlopen(url, timeout=60).read()  # noqa: E731, S310
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.monotonic
    _last: float = float("-inf")

    def one(self, url: str) -> Outcome:
        tries = 0
        while True:
            wait = self._last + self.spacing - self.clock()
            if wait > 0:
                self.sleep(wait)
            self._last = self.clock()
            try:
                return Outcome(url, self.get(url))
            except (HTTPError, URLError, OSError) as e:
                lasting = isinstance(e, HTTPError) and e.code != 429 and e.code < 500
                if lasting or tries >= self.retries:
                    return Outcome(url, error=str(e) or type(e).__name__)
                length = min(self.pause * 2**tries, self.longest_pause)
                self.sleep(length * (1 + 0.3 * random.random()))  # noqa: S311
                tries += 1

    def all(self, urls: Iterable[str], log: str | None = None) -> list[Outcome]:
        """Outcomes of the URLs that the log doesn't list yet; successes are appended to it."""
        known = set()
        if log and Path(log).exists():
            for line in Path(log).read_text().splitlines():
                try:
                    known.add(json.loads(line)["url"])
                except (ValueError, KeyError, TypeError):
                    continue  # a line cut short by a crash
        out, run = [], 0
        for url in urls:
            if url in known:
                continue
            if run >= self.failures_allowed:
                out.append(Outcome(url, error="stopped after repeated failures"))
                continue
            got = self.one(url)
            out.append(got)
            run = run + 1 if got.error else 0
            if log and not got.error:
                with open(log, "a") as file:
                    file.write(json.dumps({"url": url, "sha256": got.sha256}) + "\n")
        return out


def snapshot(fetcher: Fetcher, url: str, folder: str) -> tuple[Path, str]:
    """The file of a URL in ``folder`` and its SHA-256; one that is already there is not fetched again."""
    place = Path(folder) / (url.split("?")[0].rstrip("/").rsplit("/", 1)[-1] or "index")
    if not place.exists():
        got = fetcher.one(url)
        if got.error:
            raise OSError(f"{url}: {got.error}")
        place.parent.mkdir(parents=True, exist_ok=True)
        place.write_bytes(got.data)
    return place, hashlib.sha256(place.read_bytes()).hexdigest()
