"""Facades: one security, and the collection of them."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime
from uuid import UUID

from pyspark.sql import DataFrame

from quarry.functions.language import detect
from quarry.operators import catalog as C
from quarry.operators import panel as P
from quarry.operators.search import search
from quarry.sources.landed import check_language


@dataclass(frozen=True)
class Market:
    """The tables that facades read: catalogs by language, listings, sheets of all securities.

    With check_ids, as for real listings, the id of a security must be a UUID where its sheet is asked for.
    """

    catalog: DataFrame
    listings: DataFrame
    sheets: DataFrame
    check_ids: bool = True

    def of(self, language: str) -> DataFrame:
        df = C.of_language(self.catalog, language)
        if df.isEmpty():
            raise ValueError(f"no securities in language {language!r}")
        return df


class Securities:
    """Lists, filters and search over a market; frames are lazy, lists are collected."""

    def __init__(self, market: Market) -> None:
        self.market = market

    def list(self, language: str = "en") -> list[str]:
        return [r[0] for r in C.symbols(self.market.of(check_language(language))).collect()]

    def list_with_names(self, language: str = "en") -> DataFrame:
        return C.with_names(self.market.of(check_language(language)))

    def filter_by_sector(self, sector: str, language: str = "en") -> list[str]:
        df = C.in_sector(C.of_language(self.market.catalog, language), sector)
        return [r[0] for r in C.symbols(df).collect()]

    def filter_by_market(self, market: str, language: str = "en") -> list[str]:
        df = C.in_market(C.of_language(self.market.catalog, language), market)
        return [r[0] for r in C.symbols(df).collect()]

    def search(self, query: str, limit: int = 5, language: str = "auto") -> list[Security]:
        """The best matches; language "auto" takes Thai for a query with Thai letters."""
        language = detect(query) if language == "auto" else check_language(language)
        hits = search(self.market.of(language), query, limit, language).collect()
        return [Security._from_row(self.market, r.asDict(), language) for r in hits]


class Security:
    """One security by its symbol, in either case."""

    def __init__(self, market: Market, symbol: str, language: str = "en") -> None:
        found = C.lookup(C.of_language(market.catalog, language), symbol.upper()).collect()
        if not found:
            raise ValueError(f"no security {symbol.upper()!r}")
        self._set(market, found[0].asDict(), language)

    @classmethod
    def _from_row(cls, market: Market, row: dict, language: str) -> Security:
        one = cls.__new__(cls)
        one._set(market, row, language)
        return one

    def _set(self, market: Market, row: dict, language: str) -> None:
        self.market, self.language, self.info, self.updated = market, language, row, datetime.now(UTC)

    def __getattr__(self, name: str) -> str:
        column = C.PROFILE.get(name)
        if column is None:
            raise AttributeError(name)
        return self.info.get(column) or "-"

    def _sheets(self) -> DataFrame:
        """The sheets of the first listing of this symbol."""
        ident = C.lookup(self.market.listings, self.info["symbol"], "name").select("security_id").first()
        if ident is not None and self.market.check_ids:
            try:
                UUID(str(ident[0]))
            except ValueError:
                raise ValueError(f"the id of {self.info['symbol']} is no UUID: {ident[0]!r}") from None
        df = None if ident is None else self.market.sheets.where(self.market.sheets["security_id"] == ident[0])
        if df is None or df.isEmpty():
            raise ValueError(f"no financial sheet for {self.info['symbol']}")
        return df

    @property
    def quarter_dataframe(self) -> DataFrame:
        return P.quarterly(self._sheets(), self.language == "th").drop("security_id", "ord")

    @property
    def yearly_dataframe(self) -> DataFrame:
        return P.yearly(self._sheets(), self.language == "th").drop("security_id", "ord")

    def __repr__(self) -> str:
        s = int((datetime.now(UTC) - self.updated).total_seconds())
        ago = "just now" if s < 10 else f"{s} seconds ago" if s < 120 else f"{s // 60} minutes ago"
        return f'<Security "{self.symbol}" - updated {ago}>'
