"""A data source for paged REST and HTML documents: ``spark.read.format("paged_http")``.

A *site* is an address that may lead on to more. How it does is the option ``paging``: ``none`` (it is one page), ``next`` (the link that
the option ``next`` matches in a page names the page after it), ``number`` ({page} in the address counts from ``first``) or ``offset`` ({offset} in the address
grows by ``step``). Pages end at a page that isn't there, at ``most`` pages, and where nothing fresh comes: after ``patience`` pages in a row without an item that the
site hasn't shown before (``items`` matches the items of a page), for offsets after a page of fewer than ``step`` items.

One partition a host: a host is asked by one task, site after site, with a pause between requests, so any number of executors stays polite. A page that
isn't there ends its site; other errors are tried again with growing pauses, then give a null body. Addresses with file:// are read from disk, a folder there
by the one file that a table writer left in it (for captured pages and tests); each site of such is a partition.
"""

from __future__ import annotations

import glob
import os
import re
import time
import urllib.error
import urllib.request
from urllib.parse import unquote, urljoin, urlparse

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Sites(InputPartition):
    def __init__(self, sites: list[str]):
        self.sites = sites


def fetch(url: str, agent: str, tries: int, timeout: float, wait=time.sleep) -> tuple[str | None, int]:
    """(body, status); status 0: gave up."""
    if url.startswith("file://") and os.path.isdir(folder := unquote(urlparse(url).path)):
        url = next((f"file://{f}" for f in sorted(glob.glob(os.path.join(folder, "part-*")))), url + "/none")
    for attempt in range(tries):
        try:
            request = urllib.request.Request(url, headers={"User-Agent": agent, "Accept-Language": "nl,en-US;q=0.8,en;q=0.6"})
            with urllib.request.urlopen(request, timeout=timeout) as r:  # noqa: S310
                return r.read().decode("utf-8", "replace"), r.status or 200
        except urllib.error.HTTPError as e:
            if e.code in (404, 410):
                return None, e.code
        except (urllib.error.URLError, OSError) as e:
            if isinstance(getattr(e, "reason", e), FileNotFoundError):
                return None, 404
        wait(2 * (attempt + 1))
    return None, 0


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        get = options.get
        self.paging = get("paging", "none")
        if self.paging not in ("none", "next", "number", "offset"):
            raise ValueError(f"no such paging: {self.paging}")
        self.sites = [u for u in get("urls", "").split("\n") if u]
        self.delay, self.tries, self.timeout, self.agent = float(get("delay", 1.2)), int(get("tries", 3)), float(get("timeout", 40)), get("agent", "gleba/1.0")
        self.next, self.items = re.compile(get("next", r'rel="?next"?[^>]*href="([^"]+)"'), re.I), re.compile(get("items", r'href="([^"]+)"'))
        self.first, self.step, self.most, self.patience = int(get("first", 1)), int(get("step", 1000)), int(get("most", 1000)), int(get("patience", 2))

    def partitions(self):
        hosts: dict[str, list[str]] = {}
        for url in self.sites:
            hosts.setdefault(urlparse(url).netloc or (url if self.paging != "none" else "file"), []).append(url)
        return [Sites(v) for v in hosts.values()]

    def read(self, partition):
        asked = False
        for site in partition.sites:
            for page, url in enumerate(self._pages(site)):
                if asked:
                    time.sleep(self.delay)
                body, status = fetch(url, self.agent, self.tries, self.timeout)
                asked = True
                self._body = body
                yield site, url, page, status, body
                if status in (404, 410):
                    break

    def _pages(self, site):
        """The addresses of a site, each given out after the page before it has been read."""
        if self.paging == "none":
            yield site
            return
        seen, visited, dry, url = set(), set(), 0, site
        for n in range(self.most):
            at = url.replace("{page}", str(self.first + n)).replace("{offset}", str(n * self.step))
            if at in visited:  # a page that names itself as the next
                return
            visited.add(at)
            yield at
            body = self._body
            found = self.items.findall(body) if body else []
            dry = 0 if set(found) - seen else dry + 1
            seen |= set(found)
            if len(found) < self.step if self.paging == "offset" else dry >= self.patience:
                return
            if self.paging == "next":
                link = self.next.search(body or "")
                if not link:
                    return
                url = urljoin(at, link.group(1).replace("&amp;", "&"))


class PagedHttp(DataSource):
    @classmethod
    def name(cls):
        return "paged_http"

    def schema(self):
        return "site string, url string, page int, status int, body string"

    def reader(self, schema):
        return PagedReader(self.options)
