"""Operators for building language-model training corpora.

Nothing outside this package imports it; ``catalog.queries()`` lists the
registered ``opN_*`` queries."""
