"""DataFrame -> DataFrame operators. All are lazy; those without window ranks also run on streams."""
