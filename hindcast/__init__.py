"""hindcast: event-analogue retrieval and density forecasting as Spark DataFrame plans."""
