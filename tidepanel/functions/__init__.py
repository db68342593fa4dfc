"""Formula language, distributions and small linear algebra."""
