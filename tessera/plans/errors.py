"""Typed rejections. Everything that can be checked without data is raised before any Spark job."""


class RequestError(ValueError):
    """A request that this engine does not answer."""


class UnknownField(RequestError): ...


class AmbiguousField(RequestError): ...


class UnknownOperator(RequestError): ...


class UnknownAggregation(RequestError): ...


class NonNumeric(RequestError): ...


class TypeIncompatible(RequestError): ...


class UnknownCast(RequestError): ...


class NonFiniteValue(RequestError): ...


class UnsupportedFormat(RequestError): ...


class RequestShape(RequestError): ...
