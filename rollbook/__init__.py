"""Early-warning analytics as Spark DataFrame operations.

Every public function takes and returns DataFrames (or Columns); the plans
package strings them together into training, inference and explanation runs.
"""
