"""The queries over the driver's tables; importing the package registers all of them."""

from millrace.plans import catalogue, gapped, relational, tracked  # noqa: F401
