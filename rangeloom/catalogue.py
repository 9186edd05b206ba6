"""All queries of the engine and the SQL that states what each returns."""

from rangeloom.queries import ORACLE_SQL, QUERIES, lists, maps, products, reductions

__all__ = ["ORACLE_SQL", "QUERIES", "lists", "maps", "products", "reductions"]
