"""Image-survey measurement, selection and audit tables on PySpark."""
