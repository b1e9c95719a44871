"""Per-table permissions."""

from __future__ import annotations

from dataclasses import dataclass, field

from .errors import AccessDenied

READ, INSERT, UPDATE, DELETE = 1, 2, 4, 8
FLAGS = ("admin", "manage_acl", "migrate")


@dataclass
class Grants:
    admin: bool = False
    manage_acl: bool = False
    migrate: bool = False
    all_tables: int = 0
    tables: dict[str, int] = field(default_factory=dict)

    def allows(self, table: str, bit: int) -> bool:
        """Admin passes table checks only."""
        return self.admin or bool((self.all_tables | self.tables.get(table, 0)) & bit)


class Acl:
    """Grants by identity; the last identity that may manage them can't lose that."""

    def __init__(self, grants: dict[str, Grants] | None = None):
        self.grants = grants or {}

    @classmethod
    def of(cls, saved: dict | None) -> Acl | None:
        return None if saved is None else cls({k: Grants(**v) for k, v in saved.items()})

    def saved(self) -> dict:
        return {k: vars(v) for k, v in self.grants.items()}

    def identities(self) -> list[str]:
        return sorted(self.grants)

    def granted(self, identity: str) -> Grants:
        return self.grants.get(identity, Grants())

    def require(self, identity: str | None, table: str, bit: int) -> None:
        if not self.granted(identity or "").allows(table, bit):
            raise AccessDenied(f"{identity} may not do this to {table}")

    def require_flag(self, identity: str | None, flag: str) -> None:
        if not getattr(self.granted(identity or ""), flag):
            raise AccessDenied(f"{identity} lacks {flag}")

    def _keeps_a_manager(self, but: str) -> None:
        if self.granted(but).manage_acl and not any(g.manage_acl for k, g in self.grants.items() if k != but):
            raise AccessDenied("the last manager of grants can't be removed")

    def grant(self, identity: str, *flags: str, table: str | None = None, bits: int = 0) -> None:
        g = self.grants.setdefault(identity, Grants())
        for f in flags:
            if f not in FLAGS:
                raise ValueError(f)
            setattr(g, f, True)
        if table is None:
            g.all_tables |= bits
        else:
            g.tables[table] = g.tables.get(table, 0) | bits

    def revoke(self, identity: str, *flags: str, table: str | None = None, bits: int = 0) -> None:
        if identity not in self.grants:
            return
        if "manage_acl" in flags:
            self._keeps_a_manager(identity)
        g = self.grants[identity]
        for f in flags:
            setattr(g, f, False)
        if table is None:
            g.all_tables &= ~bits
        else:
            g.tables[table] = g.tables.get(table, 0) & ~bits

    def remove(self, identity: str) -> None:
        self._keeps_a_manager(identity)
        self.grants.pop(identity, None)
