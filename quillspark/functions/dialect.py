"""One query text for two engines: Spark runs it, DuckDB checks it. Only the primitives that differ are spelled here."""

from __future__ import annotations


class Spark:
    def rx(self, pattern: str) -> str:
        return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def sub(self, t: str, pattern: str, by: str = "") -> str:
        return f"regexp_replace({t}, {self.rx(pattern)}, '{by}')"

    def count(self, t: str, pattern: str) -> str:
        return f"CAST(regexp_count({t}, {self.rx(pattern)}) AS BIGINT)"

    def all(self, t: str, pattern: str) -> str:
        return f"regexp_extract_all({t}, {self.rx(pattern)}, 0)"

    def like(self, t: str, pattern: str) -> str:
        return f"({t} RLIKE {self.rx(pattern)})"

    def rows(self, source: str, keep: str, array: str, names: str = "idx, s") -> str:
        """A row with its number (from 0) for each element of an array."""
        return f"SELECT {keep}, t.* FROM (SELECT {keep}, {array} AS a_ FROM {source}) LATERAL VIEW posexplode(a_) t AS {names}"

    def split(self, t: str, pattern: str) -> str:
        return f"split({t}, {self.rx(pattern)})"

    def chars(self, t: str) -> str:
        return f"filter(split({t}, ''), x -> x <> '')"

    def keep(self, a: str, body: str) -> str:
        return f"filter({a}, x -> {body})"

    def map(self, a: str, body: str) -> str:
        return f"transform({a}, x -> {body})"

    def grams(self, a: str, n: int) -> str:
        """The n-grams of an array of characters."""
        if n == 1:
            return a
        parts = ", ".join(f"c[i + {k}]" for k in range(n))
        # the array is evaluated once, as the only element of another
        return f"transform(array({a}), c -> CASE WHEN size(c) >= {n} THEN transform(sequence(0, size(c) - {n}), i -> concat({parts})) ELSE array() END)[0]"

    def size(self, a: str) -> str:
        return f"CAST(size({a}) AS BIGINT)"

    def windows(self, a: str, width: int, step: int) -> str:
        """Distinct shares of full windows."""
        return f"CASE WHEN size({a}) >= {width} THEN transform(sequence(1, size({a}) - {width - 1}, {step}), i -> size(array_distinct(slice({a}, i, {width}))) / {width}D) END"

    def mean(self, a: str) -> str:
        return f"aggregate({a}, 0D, (s, x) -> s + x) / size({a})"

    def join(self, a: str, by: str = "") -> str:
        return f"array_join({a}, '{by}')"

    def sorted(self, a: str) -> str:
        return f"array_sort({a})"

    def listed(self, x: str) -> str:
        return f"array_join(array_sort(collect_list({x})), ',')"

    def point(self, ch: str) -> str:
        return f"ascii({ch})"

    half_even = staticmethod(lambda x: f"CAST(rint({x}) AS BIGINT)")
    down = staticmethod(lambda x: f"CAST({x} AS BIGINT)")


class DuckDB(Spark):
    def rx(self, pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    def sub(self, t: str, pattern: str, by: str = "") -> str:
        return f"regexp_replace({t}, {self.rx(pattern)}, '{by}', 'g')"

    def count(self, t: str, pattern: str) -> str:
        return f"CAST(len(regexp_extract_all({t}, {self.rx(pattern)})) AS BIGINT)"

    def all(self, t: str, pattern: str) -> str:
        return f"regexp_extract_all({t}, {self.rx(pattern)})"

    def like(self, t: str, pattern: str) -> str:
        return f"regexp_matches({t}, {self.rx(pattern)})"

    def rows(self, source: str, keep: str, array: str, names: str = "idx, s") -> str:
        i, s = names.split(", ")
        return f"SELECT {keep}, CAST(unnest(range(len(a_))) AS INTEGER) AS {i}, unnest(a_) AS {s} FROM (SELECT {keep}, {array} AS a_ FROM {source})"

    def split(self, t: str, pattern: str) -> str:
        return f"string_split_regex({t}, {self.rx(pattern)})"

    def chars(self, t: str) -> str:
        return f"list_filter(string_split({t}, ''), lambda x: x <> '')"

    def keep(self, a: str, body: str) -> str:
        return f"list_filter({a}, lambda x: {body})"

    def map(self, a: str, body: str) -> str:
        return f"list_transform({a}, lambda x: {body})"

    def grams(self, a: str, n: int) -> str:
        parts = ", ".join(f"({a})[{i + 1}:len({a}) - {n - 1 - i}]" for i in range(n))
        return f"CASE WHEN len({a}) >= {n} THEN list_transform(list_zip({parts}), lambda z: {' || '.join(f'z[{i + 1}]' for i in range(n))}) ELSE [] END" if n > 1 else a

    def size(self, a: str) -> str:
        return f"CAST(len({a}) AS BIGINT)"

    def windows(self, a: str, width: int, step: int) -> str:
        return f"CASE WHEN len({a}) >= {width} THEN list_transform(range(1, len({a}) - {width - 2}, {step}), lambda i: len(list_distinct(list_slice({a}, i, i + {width - 1}))) / {width}::DOUBLE) END"

    def mean(self, a: str) -> str:
        return f"list_avg({a})"

    def join(self, a: str, by: str = "") -> str:
        return f"array_to_string({a}, '{by}')"

    def sorted(self, a: str) -> str:
        return f"list_sort({a})"

    def listed(self, x: str) -> str:
        return f"array_to_string(list_sort(list({x})), ',')"

    def point(self, ch: str) -> str:
        return f"unicode({ch})"

    half_even = staticmethod(lambda x: f"CAST(round_even({x}, 0) AS BIGINT)")
    down = staticmethod(lambda x: f"CAST(trunc({x}) AS BIGINT)")
