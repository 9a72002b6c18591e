"""Date evidence: parsers, medium and the resolver, as column expressions."""
