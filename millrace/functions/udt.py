"""A user-defined type that is stored as a string."""

from __future__ import annotations

from pyspark.sql.types import DataType, StringType, UserDefinedType


class FastString:
    """A text with cheap comparison of its UTF-8 bytes."""

    def __init__(self, text: str):
        self.utf8 = text.encode()

    def __str__(self) -> str:
        return self.utf8.decode()

    def __eq__(self, other: object) -> bool:
        return isinstance(other, FastString) and self.utf8 == other.utf8

    def __hash__(self) -> int:
        return hash(self.utf8)

    def __lt__(self, other: FastString) -> bool:
        return self.utf8 < other.utf8


class FastStringType(UserDefinedType):
    @classmethod
    def sqlType(cls) -> DataType:
        return StringType()

    @classmethod
    def module(cls) -> str:
        return __name__

    def serialize(self, obj: FastString) -> str:
        return str(obj)

    def deserialize(self, datum: str) -> FastString:
        return FastString(datum)


FastString.__UDT__ = FastStringType()
