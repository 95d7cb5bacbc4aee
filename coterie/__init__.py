"""coterie: payment-graph analytics and data-preparation operators on PySpark."""
