"""DataFrame transformations: encoding, sketching, similarity joins, profiles."""
